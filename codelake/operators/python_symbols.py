"""Python symbols: the standard library's ``ast`` per file, inside mapInPandas."""

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PYTHON_SYMBOLS = (
    "repo string, path string, language string, name string, kind string, start_line int, end_line int, "
    "signature string, error string"
)

FILES_AT_ONCE = 500  # whose symbols a worker holds, however many files a batch has


class SymbolVisitor(ast.NodeVisitor):
    """Collects (name, kind, start, end, signature). Function bodies are not entered."""

    def __init__(self):
        self.found = []
        self.undocumented = []
        self.owner = None

    def visit_ClassDef(self, node):
        bases = ", ".join(dotted_name(b) for b in node.bases)
        self._add(node.name, "class", node, f"class {node.name}({bases})" if node.bases else f"class {node.name}")
        outer, self.owner = self.owner, node.name
        for statement in node.body:
            self.visit(statement)
        self.owner = outer

    def visit_FunctionDef(self, node):
        self._add_callable(node, "def")

    def visit_AsyncFunctionDef(self, node):
        self._add_callable(node, "async def")

    def visit_Import(self, node):
        for alias in node.names:
            self._add_import(alias.name, node)

    def visit_ImportFrom(self, node):
        # Leading dots of a relative import are not part of the name.
        for alias in node.names:
            self._add_import(".".join(filter(None, (node.module, alias.name))), node)

    def _add(self, name, kind, node, signature):
        if ast.get_docstring(node, clean=False) is None:
            self.undocumented.append((name, kind, node.lineno, signature))
        self.found.append((name, kind, node.lineno, node.end_lineno, signature))

    def _add_import(self, name, node):
        self.found.append((name, "import", node.lineno, node.lineno, None))

    def _add_callable(self, node, keyword):
        signature = f"{keyword} {node.name}({parameters(node.args)})"
        if self.owner:
            self._add(f"{self.owner}.{node.name}", "method", node, signature)
        else:
            self._add(node.name, "function", node, signature)


def dotted_name(node: ast.AST) -> str:
    """``a.b`` for names and attributes; what cannot be named contributes nothing."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return ".".join(filter(None, (dotted_name(node.value), node.attr)))
    return ""


def parameters(args: ast.arguments) -> str:
    # Positional-only names are left out but their defaults still count, from the right.
    required = len(args.args) - len(args.defaults)
    shown = [a.arg if i < required else a.arg + "=..." for i, a in enumerate(args.args)]
    if args.vararg:
        shown.append("*" + args.vararg.arg)
    shown += [
        a.arg if default is None else a.arg + "=..."
        for a, default in zip(args.kwonlyargs, args.kw_defaults)
    ]
    if args.kwarg:
        shown.append("**" + args.kwarg.arg)
    return ", ".join(shown)


def symbols_in_source(source: str) -> list[tuple]:
    return _visited(source).found


def undocumented_in_source(source: str) -> list[tuple]:
    """(name, kind, line, signature) of classes, functions and methods without a docstring."""
    return _visited(source).undocumented


def _visited(source: str) -> SymbolVisitor:
    visitor = SymbolVisitor()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(source)
        except SyntaxError:
            return visitor
    visitor.visit(tree)
    return visitor


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for first in range(0, len(batch), FILES_AT_ONCE):
            yield batch.iloc[first : first + FILES_AT_ONCE]


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in PYTHON_SYMBOLS.split(", ")]
    for batch in _slices(batches):
        rows = []
        for repo, path, language, content in batch.itertuples(index=False):
            try:
                rows += [(repo, path, language, *symbol, None) for symbol in symbols_in_source(content)]
            except (ValueError, RecursionError, MemoryError) as e:
                rows.append((repo, path, language, None, None, None, None, None, type(e).__name__))
        out = pd.DataFrame(rows, columns=columns)
        yield out.astype({"start_line": "Int32", "end_line": "Int32"})


def parse_python(files: DataFrame) -> DataFrame:
    """Symbol rows of the Python files, plus one row with ``error`` per file that broke the parser."""
    python = files.filter(F.col("language") == "python").select("repo", "path", "language", "content")
    return python.mapInPandas(_extract, PYTHON_SYMBOLS)


def parse_undocumented(files: DataFrame) -> DataFrame:
    """(repo, path, name, kind, start_line, signature) of what has no docstring in the Python files."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            rows = []
            for repo, path, content in batch.itertuples(index=False):
                try:
                    rows += [(repo, path, *found) for found in undocumented_in_source(content)]
                except (ValueError, RecursionError, MemoryError):
                    continue  # told of by `parse_python`
            yield pd.DataFrame(rows, columns=["repo", "path", "name", "kind", "start_line", "signature"])

    python = files.filter(F.col("language") == "python").select("repo", "path", "content")
    schema = "repo string, path string, name string, kind string, start_line int, signature string"
    return python.mapInPandas(extract, schema)
