"""JavaScript and TypeScript symbols with Spark's own regular expressions, no Python.

Each pattern is matched over the whole text once for the matches and once for the gaps before
them; the two together give every match's position and line. The expressions are written as SQL
text: as many nested lambdas built call by call would take seconds to build.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions.text import BLANK, WORD
from codelake.settings import METHOD_WINDOW_CHARS

_S = f"[{BLANK}]"
_W = f"[{WORD}]"
_Q = r"[\x27\x22]"
_MODULE = rf"{_Q}([^\x27\x22]+){_Q}"

# The patterns. (?md): ^ holds after every LF and only there.
FUNCTION = rf"(?md)^{_S}*(?:export{_S}+)?(?:async{_S}+)?function{_S}+({_W}+){_S}*\((.*?)\)"
ARROW = (
    rf"(?md)^{_S}*(?:export{_S}+)?(?:const|let|var){_S}+({_W}+){_S}*={_S}*"
    rf"(?:async{_S}+)?\(([^)]*)\){_S}*=>"
)
CLASS = rf"(?md)^{_S}*(?:export{_S}+)?class{_S}+({_W}+)(?:{_S}+extends{_S}+({_W}+))?"
METHOD = rf"(?md)^{_S}*(?:async{_S}+)?({_W}+){_S}*\(([^)]*)\)(?:{_S}*:{_S}*[^{{]+)?{_S}*\{{"
IMPORT = (
    rf"(?md)^{_S}*import{_S}+(?:\{{([^}}]+)\}}|({_W}+)|\*{_S}+as{_S}+({_W}+)){_S}+from{_S}+{_MODULE}"
)
REQUIRE = (
    rf"(?md)(?:const|let|var){_S}+(?:\{{([^}}]+)\}}|({_W}+)){_S}*={_S}*"
    rf"require{_S}*\({_MODULE}\)"
)

# Words that look like a method header and are none.
NOT_METHODS = ("constructor", "if", "for", "while", "switch", "catch")

LANGUAGES = ("javascript", "typescript")

_MATCHES = "array<struct<text:string,start:int,line:int>>"
_PLACES = "array<struct<start:int,line:int>>"
_BLOCK = 256


def _raw(regex: str) -> str:
    return f"r'{regex}'"


def _newlines(text: str) -> str:
    return rf"(length({text}) - length(replace({text}, '\n', '')))"


def _group(text: str, regex: str, group: int) -> str:
    return f"regexp_extract({text}, {_raw(regex)}, {group})"


def regex_matches(text: str, regex: str) -> str:
    """SQL for an array of (text, start, line): each match, its 0-based offset, newlines before it.

    A fold that appends copies its list every time, so matches are folded in short blocks, and the
    blocks are shifted by what stands before them.
    """
    # \G: every match begins, with the gap before it, where the last one ended.
    gapped = _raw(rf"(?md)\G((?s:.*?))({regex})")
    block = f"""aggregate(slice(pairs, b * {_BLOCK} + 1, {_BLOCK}),
        named_struct('start', 0, 'line', 0, 'out', CAST(array() AS {_MATCHES})),
        (s, p) -> named_struct(
          'start', s.start + length(p.gap) + length(p.text),
          'line', s.line + {_newlines("p.gap")} + {_newlines("p.text")},
          'out', concat(s.out, array(named_struct(
            'text', p.text, 'start', s.start + length(p.gap), 'line', s.line + {_newlines("p.gap")})))))"""
    before = f"""aggregate(blocks, named_struct('start', 0, 'line', 0, 'out', CAST(array() AS {_PLACES})),
        (s, k) -> named_struct('start', s.start + k.start, 'line', s.line + k.line,
          'out', concat(s.out, array(named_struct('start', s.start, 'line', s.line)))), s -> s.out)"""
    shifted = "named_struct('text', m.text, 'start', m.start + o.start, 'line', m.line + o.line)"
    numbers = f"sequence(0, CAST(greatest(size(pairs) - 1, 0) DIV {_BLOCK} AS int))"
    # A lambda over an array of one computes what it names once.
    return f"""transform(array(
        zip_with(regexp_extract_all({text}, {gapped}, 2), regexp_extract_all({text}, {gapped}, 1),
                 (found, gap) -> named_struct('text', found, 'gap', gap))),
      pairs -> transform(array(transform({numbers}, b -> {block})),
        blocks -> flatten(zip_with(blocks, {before}, (k, o) -> transform(k.out, m -> {shifted}))))[0])[0]"""


def _symbol(name: str, kind: str, line: str, signature: str) -> str:
    return (
        f"named_struct('name', {name}, 'kind', '{kind}', 'start_line', {line}, 'end_line', {line}, "
        f"'signature', CAST({signature} AS string))"
    )


def _if_async(text: str, then: str, otherwise: str) -> str:
    return f"IF(contains({text}, 'async'), '{then}', '{otherwise}')"


def _functions(matches: str) -> str:
    lead = _if_async("m.text", "async function ", "function ")
    name, params = (_group("m.text", FUNCTION, g) for g in (1, 2))
    signature = f"concat({lead}, {name}, '(', {params}, ')')"
    return f"transform({matches}, m -> {_symbol(name, 'function', 'm.line + 1', signature)})"


def _arrows(matches: str) -> str:
    lead = _if_async("m.text", "async ", "const ")
    name, params = (_group("m.text", ARROW, g) for g in (1, 2))
    signature = f"concat({lead}, {name}, ' = (', {params}, ') =>')"
    return f"transform({matches}, m -> {_symbol(name, 'function', 'm.line + 1', signature)})"


def _class_headers(content: str) -> str:
    """Array of (name, base, line, body, body_line); the body is a window from the next brace on."""
    after = "m.start + length(m.text) + 1"
    brace = f"locate('{{', {content}, {after})"
    skipped = f"substring({content}, {after}, greatest({brace} - ({after}), 0))"
    return f"""transform({regex_matches(content, CLASS)}, m -> named_struct(
      'name', {_group("m.text", CLASS, 1)}, 'base', {_group("m.text", CLASS, 2)}, 'line', m.line,
      'body', IF({brace} > 0, substring({content}, {brace}, {METHOD_WINDOW_CHARS}), ''),
      'body_line', m.line + {_newlines("m.text")} + {_newlines(skipped)}))"""


def _classes(headers: str) -> str:
    name, params = (_group("m.text", METHOD, g) for g in (1, 2))
    signature = f"concat({_if_async('m.text', 'async ', '')}, {name}, '(', {params}, ')')"
    method = _symbol(f"concat(c.name, '.', {name})", "method", "c.body_line + m.line + 1", signature)
    words = ", ".join(f"'{w}'" for w in NOT_METHODS)
    found = f"filter({regex_matches('c.body', METHOD)}, m -> {name} NOT IN ({words}))"
    title = "concat('class ', c.name, IF(c.base <> '', concat(' extends ', c.base), ''))"
    header = _symbol("c.name", "class", "c.line + 1", title)
    return f"flatten(transform({headers}, c -> concat(array({header}), transform({found}, m -> {method}))))"


def _imports(matches: str, regex: str, module_group: int, namespace_group: int | None) -> str:
    listed, module = _group("m.text", regex, 1), _group("m.text", regex, module_group)
    stripped = f"regexp_replace(n, {_raw(rf'^{_S}+|{_S}+\z')}, '')"
    members = f"filter(transform(split({listed}, ','), n -> {stripped}), n -> n <> '')"
    dotted = f"transform({members}, n -> concat({module}, '.', n))"
    plain = f"array({module})"
    if namespace_group is not None:
        star = f"{_group('m.text', regex, namespace_group)} <> ''"
        plain = f"IF({star}, array(concat({module}, '.*')), {plain})"
    names = f"IF({listed} <> '', {dotted}, {plain})"
    symbol = _symbol("n", "import", "m.line + 1", "NULL")
    return f"flatten(transform({matches}, m -> transform({names}, n -> {symbol})))"


def parse_javascript(files: DataFrame) -> DataFrame:
    """Symbol rows of the JavaScript and TypeScript files, in one pass without a shuffle."""
    source = files.filter(F.col("language").isin(*LANGUAGES))
    matched = source.selectExpr(
        "repo",
        "path",
        "language",
        f"{regex_matches('content', FUNCTION)} AS functions",
        f"{regex_matches('content', ARROW)} AS arrows",
        f"{_class_headers('content')} AS classes",
        f"{regex_matches('content', IMPORT)} AS imports",
        f"{regex_matches('content', REQUIRE)} AS requires",
    )
    parts = (
        _functions("functions"),
        _arrows("arrows"),
        _classes("classes"),
        _imports("imports", IMPORT, 4, namespace_group=3),
        _imports("requires", REQUIRE, 3, namespace_group=None),
    )
    return matched.selectExpr("repo", "path", "language", f"inline(concat({', '.join(parts)}))")
