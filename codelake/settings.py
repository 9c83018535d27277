"""Defaults that decide results, and the fixed value lists."""

# Directory names that are never entered.
EXCLUDED_DIRS = (
    ".git", "node_modules", "dist", "build", "venv", "__pycache__", ".venv",
    "env", ".pytest_cache", ".mypy_cache", "target", "bin", "obj",
)

# Fixed values: "*.ext" drops names with that ending, anything else names containing it.
EXCLUDED_FILES = (
    "*.pyc", "*.pyo", "*.so", "*.dylib", "*.dll", "*.exe", "*.bin", "*.lock",
)

# File suffix to language.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".c": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".h": "c",
    ".hpp": "cpp",
    ".rs": "rust",
    ".go": "go",
    ".rb": "ruby",
    ".php": "php",
    ".cs": "csharp",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".sh": "shell",
    ".bash": "shell",
    ".zsh": "shell",
    ".md": "markdown",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".xml": "xml",
    ".html": "html",
    ".css": "css",
    ".sql": "sql",
}

# Suffixes counted as code by the line counter.
CODE_SUFFIXES = (
    ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rs", ".cpp", ".c", ".h",
)

# What a symbol hit is worth.
SCORE_BASE = 1.0
SCORE_EXACT = 10.0
SCORE_PARTIAL = 5.0
SCORE_DEFINITION = 5.0
SCORE_SYMBOL = 3.0
SCORE_SIGNATURE = 2.0
SCORE_KIND = {"class": 2.0, "function": 1.5, "method": 1.5, "import": 1.0}
SCORE_OTHER_KIND = 1.0

# BM25.
BM25_K1 = 1.2
BM25_B = 0.75
BM25_MIN_IDF = 1e-6

IGNORE_FILE = ".codelakeignore"
MAX_FILE_BYTES = 2 * 1024 * 1024
BINARY_PROBE_BYTES = 8192
CHUNK_LINES = 300
METHOD_WINDOW_CHARS = 5000
DEFAULT_TOPK = 10
MAX_TOPK = 100
MAX_CONTEXT = 10
SCORE_DIGITS = 6
SCHEMA_VERSION = "1.0"
