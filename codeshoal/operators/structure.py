"""Functions, classes, imports and complexity, one file row at a time.

All of a file's structure is found inside its own row: the text is masked
(strings and comments blanked, line numbers kept), cut into lines, and one
fold carries the stack of open definitions.  No shuffle, no sort, and a file
is never spread over rows that would have to be brought together again.

Line-based, so limits apply: several definitions on one line share that line's
braces, and an expression-bodied arrow function ends on its own line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalogs as C
from ..functions import text as X
from ..functions.bind import built_once, let, removed, struct_of, tally
from ..session import scratch_dir
from .rules import KEYS

BRACE_LANGUAGES = ("javascript", "java", "go")
NOT_METHODS = r"^(?:if|for|while|switch|catch|function|with|return|super|do|else|new|typeof|await)$"
NOT_TYPES = r"^(?:return|new|throw|else|case|assert|package|import|class|interface|enum)\b"

# Stands for the end of a multi-line string in masked text.
RESUMED = "\x01"
# Set around the tokens of a text while it is masked.
AROUND = "\x02"

# --- masking ------------------------------------------------------------------


# Tokens that hold no code, tried at each place from left to right once escapes are gone.  A quote
# or mark inside another token is thus never taken for a start of its own.  The only group is a
# token that is not a comment up to the end of its line: such a comment leaves nothing.
PY_TOKENS = r'''(?d)("{3}[\s\S]*?"{3}|'{3}[\s\S]*?'{3}|"[^"\n]*"|'[^'\n]*')|#[^\n]*'''
STRING = r"""(?:"[^"\n]*"|'[^'\n]*')"""


def _within(opening: str, closing: str, other: str, inside: str) -> str:
    """A pattern of ``opening``, runs without the characters ``other``, ``inside`` ones, ``closing``."""
    return rf"{opening}[^{other}]*+(?:{inside}[^{other}]*+)*+{closing}"


def _template(inner: str) -> str:
    """A template whose ``${...}`` parts may hold strings, braces and templates like ``inner``."""
    value = _within(r"\$\{", r"\}", "`{}\"'", rf"(?:{STRING}|{inner}|\{{[^{{}}`]*+\}}|[\"'])")
    return _within("`", "`", "`$", rf"(?:{value}|\$(?!\{{))")


def _parentheses(levels: int) -> str:
    """Balanced parentheses, nested so deep, that may hold strings and templates."""
    inside = rf"{STRING}|`[^`]*+`"
    if levels:
        inside += "|" + _parentheses(levels - 1)
    return _within(r"\(", r"\)", "()`\"'", f"(?:{inside})")


# A template in a value of a template in a value of one; others end at the next back quote.
BRACE_VALUES = _template(_template("`[^`$]*+`")) + (
    r"""|`[^`]*`|"[^"\n]*"|'[^'\n]*'|/\*[\s\S]*?(?:\*/|\z)""")
BRACE_TOKENS = rf"(?d)({BRACE_VALUES})|//[^\n]*"
GAP = r"(?:\s|//[^\n]*+|/\*[\s\S]*?(?:\*/|\z))*+"
LITERAL = r"/(?![/*])[^/\[\n]*+(?:\[[^\]\n]*+\][^/\[\n]*+)*+/"
# What a slash after a bracket means is told by the word before the matching one.
CONTROL = r"(?:if|while|for|with)\s*" + _parentheses(4)
# A regex literal comes where a value is expected: after a mark or word, and any white space and
# comments.  The token begins with that mark or word.  A slash in a class does not end it.
JS_TOKENS = rf"(?d)({BRACE_VALUES}" + (
    r"|(?:[=(,:;!&|?{}\[]|(?<==)>|(?<!\+)\+|(?=[acdeiortvy])(?<![\w$.])(?:return|typeof|case|in|of"
    r"|void|delete|throw|else|do|await|yield|instanceof)(?![\w$])"
    rf"|(?=[fiw])(?<![\w$.]){CONTROL}){GAP}{LITERAL})|//[^\n]*"
)
# What such a token begins with.
BEFORE_LITERAL = r"^(?:[a-z]+|[^a-z\"'/`#])"


def _blank_token(token: Column) -> Column:
    """What stands for a token: its newlines, and an empty string where it is a value.

    A string over several lines ends in a marker: what follows it on its line continues
    an expression.
    """
    newlines = F.regexp_replace(token, r"[^\n]+", "")
    several = token.startswith("`") | F.rlike(token, F.lit(r"""^(?:"{3}|'{3})"""))
    # Strings in a control head become empty ones; the rest of it is code.
    head = F.regexp_replace(
        F.regexp_extract(token, f"^{CONTROL}", 0), rf"{STRING}|`[^`]*+`", '""')
    return (
        F.when(several, F.concat(F.lit('""'), newlines, F.lit(RESUMED)))
        .when(token.startswith("#") | token.startswith("//"), F.lit(""))
        .when(token.startswith("/*"), newlines)
        .when(F.rlike(token, F.lit(f"^{CONTROL}")), F.concat(
            head, F.regexp_replace(F.regexp_replace(token, f"^{CONTROL}", ""), r"[^\n]+", ""),
            F.lit('""')))
        .otherwise(F.concat(
            F.regexp_extract(token, BEFORE_LITERAL, 0), newlines, F.lit('""')))
    )


def _blank_tokens(content: Column, tokens: str) -> Column:
    def marked(text: Column) -> Column:
        """One search sets every token apart and drops the comments: code and tokens take turns."""
        pieces = F.split(F.regexp_replace(text, tokens, f"{AROUND}$1{AROUND}"), AROUND, -1)
        return F.array_join(F.transform(
            pieces,
            lambda piece, i: F.when((i % 2 == 1) & (piece != ""), _blank_token(piece))
            .otherwise(piece),
        ), "")

    def paired(text: Column) -> Column:
        """The same for a text that holds the mark itself; the pattern is compiled for each text."""
        return F.array_join(F.zip_with(
            F.split(text, tokens, -1), F.regexp_extract_all(text, F.lit(tokens), 0),
            lambda code, token: F.concat(code, F.coalesce(_blank_token(token), F.lit(""))),
        ), "")

    unescaped = F.when(
        content.contains("\\"), F.regexp_replace(content, r"(?d)\\.", "_")).otherwise(content)
    return let(unescaped, lambda text: F.when(text.contains(AROUND), paired(text)).otherwise(
        marked(text)))


def _mask(content: Column, language: str) -> Column:
    if language == "javascript":
        # A file begins like a statement.
        masked = _blank_tokens(F.concat(F.lit(";"), content), JS_TOKENS)
        return masked.substr(2, 2 ** 31 - 1)
    return _blank_tokens(content, PY_TOKENS if language == "python" else BRACE_TOKENS)


def mask(content: Column, language: Column) -> Column:
    """Content without string bodies and comments; line numbers unchanged."""
    masked = F.when(language == "python", _mask(content, "python"))
    for name in BRACE_LANGUAGES:
        masked = masked.when(language == name, _mask(content, name))
    return masked


# --- decisions ----------------------------------------------------------------

PY_DECISION = r"^\s*(?:async\s+)?(?:if|for|while|except|with|assert)\b"
PY_KEYWORD = r"^\s*(?:async\s+)?(?:if|elif|while|assert)\b"
PY_ANY = r"\b(?:if|for|while|except|with|assert)\b"
PY_TERNARY = r"\bif\b.+?\belse\b"
JS_DECISION = r"\bif\s*\(|\bwhile\s*\(|\bwith\s*\("
JS_DO_TAIL = r"\}\s*while\s*\("
JS_FOR = r"\bfor\s*\([^;)]*;"


def decision_hits(line: Column, language: str) -> Column:
    """Decision points on a masked line (elif and boolean operators are none).

    One cheap test decides whether the line is worth counting.
    """
    if language == "python":
        counted = F.rlike(line, F.lit(PY_DECISION)).cast("int") + F.when(
            line.contains("else"), tally(F.regexp_replace(line, PY_KEYWORD, ""), PY_TERNARY)
        ).otherwise(0)
        return F.when(F.rlike(line, F.lit(PY_ANY)), counted).otherwise(0)
    if language == "javascript":
        counted = tally(line, JS_DECISION) + tally(line, JS_FOR) - tally(line, JS_DO_TAIL)
        return F.when(line.contains("("), counted).otherwise(0)
    return F.lit(0)


# --- definitions on a line ------------------------------------------------------

PY_DEF = r"(?U)^\s*(?:async\s+)?def\s+(\w+)\s*\("
PY_CLASS = r"(?U)^\s*class\s+(\w+)\s*[:(]"
JS_DECL = r"^\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s+([\w$]+)\s*\("
JS_METHOD = r"^\s*(?:(?:static|async|get|set)\s+)*(#?[\w$]+)\s*\([^()]*\)\s*\{"
JS_CLASS = r"^\s*(?:export\s+(?:default\s+)?)?class\s+([\w$]+)"
JS_ANONYMOUS = r"=>|\bfunction\b(?!\s*\*)"
JAVA_METHOD = (
    r"^\s*(?:@\w+\s+)*(?:(?:public|protected|private|static|final|abstract|synchronized"
    r"|native|default|strictfp)\s+)*(?:<[^>]+>\s+)?(\w[\w.<>\[\], ?]*?)\s+(\w+)\s*\("
)
JAVA_CLASS = r"^\s*(?:(?:public|protected|private|static|final|abstract|strictfp)\s+)*class\s+(\w+)"
GO_FUNC = r"^func\s+(\w+)\s*[(\[]"


def _one(kind: str, name: Column, when: Column) -> Column:
    return F.when(when, struct_of(kind=F.lit(kind), name=name))


def definitions(line: Column, language: str) -> Column:
    """Array of (kind, name) that start on a masked line, NULL where none can."""
    def group(pattern: str, index: int = 1) -> Column:
        return F.regexp_extract(line, pattern, index)

    def named(kind: str, pattern: str, index: int = 1) -> Column:
        return let(group(pattern, index), lambda name: _one(kind, name, name != ""))

    if language == "python":
        found = F.array(named("function", PY_DEF), named("class", PY_CLASS))
        possible = line.contains("def ") | line.contains("class ") | line.contains("\t")
    elif language == "javascript":
        method = let(
            group(JS_METHOD),
            lambda n: _one("function", n, (n != "") & ~F.rlike(n, F.lit(NOT_METHODS))),
        )
        declared = (group(JS_DECL) != "").cast("int")
        anonymous = F.array_repeat(
            struct_of(kind=F.lit("function"), name=F.lit("<anonymous>")),
            F.greatest(tally(line, JS_ANONYMOUS) - declared, F.lit(0)),
        )
        found = F.concat(
            F.array(named("function", JS_DECL), method, named("class", JS_CLASS)), anonymous
        )
        possible = line.contains("(") | line.contains("class") | line.contains("=>")
    elif language == "java":
        method = let(
            struct_of(type=group(JAVA_METHOD), name=group(JAVA_METHOD, 2)),
            lambda m: _one(
                "function", m["name"],
                (m["name"] != "")
                & ~F.rlike(m["type"], F.lit(NOT_TYPES))
                & ~F.rlike(m["name"], F.lit(NOT_METHODS)),
            ),
        )
        found = F.array(method, named("class", JAVA_CLASS))
        possible = line.contains("(") | line.contains("class")
    else:
        found = F.array(named("function", GO_FUNC))
        possible = line.startswith("func")
    return F.when(possible, F.array_compact(found)).otherwise(
        F.array().cast("array<struct<kind:string,name:string>>")
    )


# A statement of a line with braces: up to a brace or semicolon outside parentheses that the line
# closes.  The brace before the ``while`` of a ``do`` stays with it.
STATEMENT = (rf"(?:[^{{}};()]++|{_parentheses(3)}|[()])*+(?:[{{;]|\}}(?!\s*while\b))"
             r"|.+$")
BLANKS = " \t\r\f"
# Statements folded at a time (lines, for Python).
BLOCK_LINES = 200

# --- the fold -------------------------------------------------------------------

ENTRY = (
    "struct<start:int,kind:string,name:string,stop:int,level:int,complexity:int,"
    "header_end:int,balance:int,decorated:boolean,opened:boolean,parent:int,parent_kind:string,"
    "head:string>"
)

def _marks(masked: Column, language: str) -> Column:
    """One struct per non-blank masked line, with what its language needs."""
    python = language == "python"
    zero, no = F.lit(0), F.lit(False)

    def describe(line: Column, body: Column, number: Column) -> Column:
        first = F.left(body, F.lit(1))
        return struct_of(
            ln=number,
            indent=F.length(line) - F.length(body) if python else zero,
            continues=first.isin(")", "]", "}", RESUMED) if python else no,
            braces_open=zero if python else removed(line, "{"),
            braces_close=zero if python else removed(line, "}"),
            balance=removed(line, "([{") - removed(line, ")]}") if python else zero,
            hits=decision_hits(line, language),
            defs=definitions(line, language),
            decorator=first == "@" if python else no,
            ends_statement=no if python else F.rtrim(body, F.lit(BLANKS)).endswith(";"),
            head=F.lit("") if python else F.regexp_extract(line, r"(?s)^[^)]*+\)?", 0),
        )

    def mark(line: Column, i: Column) -> Column:
        # Only spaces and tabs indent; a blank line has nothing left.
        return F.when(line != "", let(
            F.ltrim(line, F.lit(BLANKS)),
            lambda body: F.when(F.length(body) > 0, describe(line, body, i + 1)),
        ))

    def parts(line: Column, i: Column) -> Column:
        """The marks of a line's statements."""
        return F.when(
            F.rlike(line, F.lit(r"[{};]\s*[^\s{};]")),
            F.transform(F.regexp_extract_all(line, F.lit(STATEMENT), 0), lambda s: mark(s, i)),
        ).otherwise(F.array(mark(line, i)))

    lines = X.split_lines(masked)
    return F.array_compact(
        F.transform(lines, mark) if python else F.flatten(F.transform(lines, parts)))


def _opened_entries(mark: Column, state: Column, level: Column, braces: bool) -> Column:
    """Stack entries for the definitions starting on a line."""
    top = F.try_element_at(state["open"], F.lit(-1))
    done = mark["balance"] <= 0 if not braces else F.lit(True)
    return F.transform(
        mark["defs"],
        lambda d: struct_of(
            start=mark["ln"],
            kind=d["kind"],
            name=d["name"],
            stop=F.lit(0),
            level=level,
            complexity=F.lit(1) + mark["hits"],
            header_end=F.when(done, mark["ln"]).otherwise(F.lit(0)),
            balance=mark["balance"],
            decorated=state["decorator"],
            opened=F.lit(False),
            parent=F.coalesce(top["start"], F.lit(0)),
            parent_kind=F.coalesce(top["kind"], F.lit("")),
            head=mark["head"],
        ).cast(ENTRY),
    )


def _close(entries: Column, stop: Column) -> Column:
    return F.transform(entries, lambda e: e.withField("stop", stop))


def _python_step(state: Column, mark: Column) -> Column:
    """Indentation decides: a line at or left of a definition ends it."""
    def ends(entry: Column) -> Column:
        return ~mark["continues"] & (entry["header_end"] > 0) & (
            entry["level"] >= mark["indent"]
        )

    def carry(entry: Column) -> Column:
        balance = entry["balance"] + mark["balance"]
        waiting = entry["header_end"] == 0
        return (
            entry.withField("complexity", entry["complexity"] + mark["hits"])
            .withField("balance", F.when(waiting, balance).otherwise(entry["balance"]))
            .withField(
                "header_end",
                F.when(waiting & (balance <= 0), mark["ln"]).otherwise(entry["header_end"]),
            )
        )

    closed = F.filter(state["open"], ends)
    kept = F.transform(F.filter(state["open"], lambda e: ~ends(e)), carry)
    fresh = let(
        state.withField("open", kept),
        lambda s: F.concat(s["open"], _opened_entries(mark, s, mark["indent"], False)),
    )
    busy = (
        (F.size(mark["defs"]) > 0)
        | (mark["hits"] > 0)
        | F.exists(state["open"], lambda e: ends(e) | (e["header_end"] == 0))
    )
    return F.when(
        busy,
        struct_of(
            open=fresh,
            done=F.concat(state["done"], _close(closed, state["last"])),
            last=mark["ln"],
            depth=state["depth"],
            decorator=mark["decorator"],
        ),
    ).otherwise(
        state.withField("last", mark["ln"]).withField("decorator", mark["decorator"])
    )


def _brace_step(state: Column, mark: Column) -> Column:
    """Brace depth decides: a definition ends when its own depth returns."""
    depth = state["depth"] + mark["braces_open"] - mark["braces_close"]

    def carry(entry: Column) -> Column:
        return entry.withField("complexity", entry["complexity"] + mark["hits"])

    def settle(entries: Column) -> Column:
        """After the line: note opened bodies, find finished ones."""
        return F.transform(
            entries,
            lambda e: e.withField("opened", e["opened"] | (mark["braces_open"] > 0)),
        )

    def ends(entry: Column) -> Column:
        bodiless = ~entry["opened"] & (entry["start"] == mark["ln"]) & (
            (entry["name"] == "<anonymous>") | mark["ends_statement"]
        )
        return (entry["opened"] & (depth <= entry["level"])) | bodiless

    entries = settle(
        F.concat(
            F.transform(state["open"], carry),
            _opened_entries(mark, state, state["depth"], True),
        )
    )
    busy = (
        (F.size(mark["defs"]) > 0)
        | (mark["hits"] > 0)
        | ((mark["braces_open"] + mark["braces_close"] > 0) & (F.size(state["open"]) > 0))
    )
    return F.when(
        busy,
        let(
            entries,
            lambda all_: struct_of(
                open=F.filter(all_, lambda e: ~ends(e)),
                done=F.concat(state["done"], _close(F.filter(all_, ends), mark["ln"])),
                last=mark["ln"],
                depth=depth,
                decorator=F.lit(False),
            ),
        ),
    ).otherwise(state.withField("last", mark["ln"]).withField("depth", depth))


def entries(content: Column, language: Column, masked: Column | None = None) -> Column:
    """Array of all functions and classes of a file, in order of appearance.

    ``masked`` is the file's masked text, where the caller has it already.
    """
    none = F.array().cast(f"array<{ENTRY}>")
    start = struct_of(
        open=none, done=none, last=F.lit(0), depth=F.lit(0), decorator=F.lit(False)
    )

    def finish(state: Column) -> Column:
        return F.array_sort(F.concat(state["done"], _close(state["open"], state["last"])))

    def fold(name: str) -> Column:
        own = _mask(content, name) if masked is None else masked
        step = _python_step if name == "python" else _brace_step

        def block_step(state: Column, block: Column) -> Column:
            return let(
                F.aggregate(block, state.withField("done", none), step),
                lambda s: s.withField("done", F.concat(state["done"], s["done"])),
            )

        # A fold copies its state at every step.  Folding block by block keeps
        # the finished entries of a long file out of the inner, per-line state.
        blocks = let(
            _marks(own, name),
            lambda marks: F.transform(
                F.sequence(F.lit(0), F.floor(F.size(marks) / BLOCK_LINES).cast("int")),
                lambda i: F.slice(marks, i * BLOCK_LINES + 1, BLOCK_LINES),
            ),
        )
        return F.aggregate(blocks, start, block_step, finish)

    expr = F.when(language == "python", fold("python"))
    for name in BRACE_LANGUAGES:
        expr = expr.when(language == name, fold(name))
    return expr.otherwise(none)


# --- tables -------------------------------------------------------------------

PY_HEADER = r"(?s)^[^(]*\((.*?)\)\s*(?:->\s*(.+?)\s*)?:"
BRACE_HEADER = r"(?s)^[^(]*\((.*?)\)"
TOP_LEVEL_COMMA = r",(?![^\[\]]*\])(?![^()]*\))(?![^{}]*\})"


@built_once
def _parameters() -> Column:
    """Plain, typed or defaulted parameters; splats and typed defaults are left out."""
    header, language = F.col("e.header"), F.col("language")
    inner = F.when(language == "python", F.regexp_extract(header, PY_HEADER, 1)).otherwise(
        F.regexp_extract(header, BRACE_HEADER, 1)
    )
    parts = F.filter(
        F.transform(F.split(inner, TOP_LEVEL_COMMA, -1), X.strip), lambda p: p != ""
    )
    none = F.array().cast("array<string>")
    return (
        F.when(
            language == "python",
            F.filter(
                parts,
                lambda p: F.rlike(p, F.lit(r"(?U)^\w+$"))
                | F.rlike(p, F.lit(r"(?Us)^\w+\s*=.*$"))
                | F.rlike(p, F.lit(r"(?U)^\*{0,2}\w+\s*:[^=]*$")),
            ),
        )
        .when(language == "javascript", F.filter(parts, lambda p: F.rlike(p, F.lit(r"^[\w$]+$"))))
        .when(language == "java", F.filter(parts, lambda p: ~p.contains("...")))
        .otherwise(none)
    )


@built_once
def _return_type() -> Column:
    header, language = F.col("e.header"), F.col("language")
    python = F.regexp_extract(header, PY_HEADER, 2)
    java = X.strip(F.regexp_extract(header, JAVA_METHOD, 1))
    return F.nullif(
        F.when(language == "python", python).when(language == "java", java).otherwise(F.lit("")),
        F.lit(""),
    )


def parse(files: DataFrame) -> DataFrame:
    """Files with an ``entries`` array: functions and classes with their headers.

    ``header`` holds the raw definition lines, with braces the masked statement up to its first
    closing bracket; texts are sliced here, once per file, so that exploding entries later does
    not copy whole files.
    """
    parsed = files.filter(F.col("language").isin("python", *BRACE_LANGUAGES))
    return parsed.withColumn("entries", _entries_with_header())


@built_once
def _entries_with_header() -> Column:
    return _with_header(None)


def _with_header(masked: Column | None) -> Column:
    return let(
        X.split_lines(F.col("content")),
        lambda lines: F.transform(
            entries(F.col("content"), F.col("language"), masked),
            lambda e: e.withField(
                "header",
                F.when(F.col("language") == "python", F.array_join(
                    F.slice(
                        lines, e["start"],
                        F.greatest(e["header_end"], e["start"]) - e["start"] + 1,
                    ),
                    "\n",
                )).otherwise(e["head"]),
            ),
        ),
    )


def _keys(df: DataFrame) -> list[str]:
    return [c for c in KEYS if c in df.columns]


@built_once
def _full_entries() -> Column:
    """Entries with header, text and distinct called names, from one parse."""
    def complete(texts: Column) -> Column:
        return F.transform(
            _with_header(texts["whole"]),
            lambda e: e.withField(
                "snippet",
                F.array_join(
                    F.slice(texts["raw"], e["start"], e["stop"] - e["start"] + 1), "\n"
                ),
            ).withField("callees", _callees(texts["masked"], e)),
        )

    # Masked once, for the entries and for the names called in them.
    return let(
        mask(F.col("content"), F.col("language")),
        lambda masked: let(
            struct_of(raw=X.split_lines(F.col("content")), whole=masked,
                      masked=X.split_lines(F.coalesce(masked, F.lit("")))), complete),
    )


def extract(files: DataFrame) -> DataFrame:
    """One row per file with its line count and complete entries, text dropped.

    Whoever needs several of the tables below should write this once and
    derive them from what was written: the parse is the expensive part.
    """
    text = F.col("content")
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return files.select(*_keys(files), n_lines.alias("n_lines"), _full_entries().alias("entries"))


def functions(files: DataFrame, with_snippet: bool = False) -> DataFrame:
    """One row per function or method, nested ones included."""
    return functions_of(extract(files) if with_snippet else parse(files), with_snippet)


def functions_of(parsed: DataFrame, with_snippet: bool = False) -> DataFrame:
    """Function rows of parsed files (from parse or extract)."""
    keys = _keys(parsed)
    exploded = parsed.select(
        *keys,
        F.explode(F.filter("entries", lambda e: e["kind"] == "function")).alias("e"),
    )
    counted = F.col("language").isin("python", "javascript")
    return exploded.select(
        *keys,
        F.col("e.name").alias("name"),
        F.col("e.start").alias("start_line"),
        F.col("e.stop").alias("end_line"),
        _parameters().alias("parameters"),
        _return_type().alias("return_type"),
        F.when(counted, F.col("e.complexity")).otherwise(1).alias("complexity"),
        *([F.col("e.snippet").alias("snippet")] if with_snippet else []),
    )


PY_PARENTS = r"(?s)^[^(]*\((.*)\)\s*:"
JS_PARENT = r"\bextends\s+([\w$.]+)"


def classes(files: DataFrame) -> DataFrame:
    """One row per class with parents and its direct methods."""
    return classes_of(parse(files))


def classes_of(parsed: DataFrame) -> DataFrame:
    """Class rows of parsed files (from parse or extract)."""
    keys = _keys(parsed)
    language = F.col("language")

    def methods(cls: Column) -> Column:
        return F.filter(
            F.col("entries"),
            lambda e: (e["kind"] == "function")
            & (e["parent_kind"] == "class")
            & (e["parent"] == cls["start"])
            & ~e["decorated"]
            & (e["name"] != "<anonymous>"),
        )

    with_methods = F.transform(
        F.filter("entries", lambda e: e["kind"] == "class"),
        lambda c: struct_of(
            name=c["name"],
            start=c["start"],
            stop=c["stop"],
            header=c["header"],
            methods=F.when(
                language.isin("python", "javascript"),
                F.transform(
                    methods(c),
                    lambda m: struct_of(
                        name=m["name"], start_line=m["start"], end_line=m["stop"]
                    ),
                ),
            ).otherwise(
                F.array().cast("array<struct<name:string,start_line:int,end_line:int>>")
            ),
        ),
    )
    python = F.filter(
        F.transform(
            F.split(F.regexp_extract(F.col("c.header"), PY_PARENTS, 1), TOP_LEVEL_COMMA, -1),
            X.strip,
        ),
        lambda p: F.rlike(p, F.lit(r"(?U)^\w+$")),
    )
    script = F.filter(
        F.array(F.regexp_extract(F.col("c.header"), JS_PARENT, 1)), lambda p: p != ""
    )
    return (
        parsed.select(*keys, F.explode(with_methods).alias("c"))
        .select(
            *keys,
            F.col("c.name").alias("name"),
            F.col("c.start").alias("start_line"),
            F.col("c.stop").alias("end_line"),
            F.when(language == "python", python)
            .when(language == "javascript", script)
            .otherwise(F.array().cast("array<string>")).alias("parent_classes"),
            F.col("c.methods").alias("methods"),
        )
    )


PY_IMPORT_LINE = r"(?U)^\s*import\s+(.+)$"
PY_FROM_LINE = r"(?U)^\s*from\s+(\S+)\s+import\s+(.+)$"
JS_IMPORT_LINE = r"""^\s*import\s+(?:(.*?)\s*from\s+)?['"]([^'"]+)['"]"""


def imports(files: DataFrame) -> DataFrame:
    """One row per import statement with its line.

    Aliases keep the imported name, and relative modules keep their dots.
    """
    keys = _keys(files)
    language = F.col("language")
    line = F.col("line")

    def names(listed: Column) -> Column:
        bare = F.regexp_replace(listed, r"[()]|#.*$", "")
        cleaned = F.transform(
            F.split(bare, ",", -1),
            lambda n: X.strip(F.regexp_replace(n, r"\s+as\s+\w+", "")),
        )
        return F.filter(cleaned, lambda n: n != "")

    is_from = F.regexp_extract(line, PY_FROM_LINE, 1) != ""
    direct = names(F.regexp_extract(line, PY_IMPORT_LINE, 1))
    from_names = names(F.regexp_extract(line, PY_FROM_LINE, 2))
    clause = F.regexp_replace(F.regexp_extract(line, JS_IMPORT_LINE, 1), r"\{.*\}", "")
    python = struct_of(
        module=F.when(is_from, F.regexp_extract(line, PY_FROM_LINE, 1)).otherwise(
            F.get(direct, F.lit(0))
        ),
        names=F.when(is_from, from_names).otherwise(
            F.slice(direct, 2, F.greatest(F.size(direct) - 1, F.lit(0)))
        ),
        is_from_import=is_from,
    )
    script = struct_of(
        module=F.regexp_extract(line, JS_IMPORT_LINE, 2),
        names=F.filter(
            F.transform(F.split(clause, ",", -1), X.strip), lambda n: F.rlike(n, F.lit(r"^[\w$]+$"))
        ),
        is_from_import=F.lit(True),
    )
    is_python = (language == "python") & (
        is_from | (F.regexp_extract(line, PY_IMPORT_LINE, 1) != "")
    )
    is_script = (language == "javascript") & (F.regexp_extract(line, JS_IMPORT_LINE, 2) != "")
    # Imports are read from raw lines, but only where the masked text shows one
    # too, so that text inside docstrings does not count.
    masked = mask(F.col("content"), language)
    paired = F.arrays_zip(
        X.split_lines(F.col("content")).alias("line"), X.split_lines(masked).alias("masked")
    )
    return (
        files.filter(language.isin("python", "javascript"))
        .select(*keys, F.posexplode(paired).alias("__pos", "__row"))
        .select(*keys, (F.col("__pos") + 1).alias("line_no"), "__row.*")
        .filter(F.col("masked").contains("import"))
        .withColumn("i", F.when(is_python, python).when(is_script, script))
        .filter(F.col("i").isNotNull())
        .select(*keys, "i.*", "line_no")
    )


@built_once
def _functions_with_imports() -> Column:
    """Functions (name, start, stop, complexity) with the import lines inside them."""
    lines = F.transform(
        X.split_lines(F.col("content")),
        lambda line, i: let(
            X.strip(line),
            lambda text: F.when(
                text.startswith("import ") | text.startswith("from "),
                struct_of(line_no=i + 1, text=text),
            ),
        ),
    )
    python = F.when(F.col("language") == "python", F.array_compact(lines)).otherwise(
        F.array().cast("array<struct<line_no:int,text:string>>")
    )
    return let(
        python,
        lambda found: F.transform(
            F.filter("entries", lambda e: e["kind"] == "function"),
            lambda e: struct_of(
                name=e["name"],
                start_line=e["start"],
                end_line=e["stop"],
                complexity=e["complexity"],
                imports=F.filter(
                    found, lambda i: (i["line_no"] >= e["start"]) & (i["line_no"] <= e["stop"])
                ),
            ),
        ),
    )


def functions_with_imports(files: DataFrame) -> DataFrame:
    """One row per function with the import lines inside it as an array."""
    keys = _keys(files)
    counted = F.col("language").isin("python", "javascript")
    return (
        parse(files)
        .select(*keys, F.explode(_functions_with_imports()).alias("f"))
        .select(*keys, "f.name", "f.start_line", "f.end_line", "f.imports",
                F.when(counted, F.col("f.complexity")).otherwise(1).alias("complexity"))
    )


def imports_in_functions(files: DataFrame) -> DataFrame:
    """PERF-P006: one finding per import line and enclosing function."""
    keys = _keys(files)
    return (
        functions_with_imports(files.filter(F.col("language") == "python"))
        .select(*keys, "name", F.explode("imports").alias("i"))
        .select(
            F.lit("performance").alias("finding_type"),
            F.lit("PERF-P006").alias("rule_id"),
            F.lit("Import Inside Function").alias("rule_name"),
            F.lit("low").alias("severity"),
            F.format_string("Import statement inside function '%s'", "name").alias("message"),
            *keys,
            F.col("i.line_no").alias("line_start"),
            F.col("i.line_no").alias("line_end"),
            F.col("i.text").alias("code_snippet"),
            F.lit(IMPORT_ADVICE).alias("suggestion"),
        )
    )


def covering(
    lookups: DataFrame, files: DataFrame, kind: str = "function"
) -> DataFrame:
    """First function or class, in order of declaration, covering each (file_id, line_no).

    The file side has one row per file, so each lookup meets one row: a hot
    file is split by the adaptive skew join on the lookup side only.
    """
    spans = parse(files).select(
        "file_id",
        F.transform(
            F.filter("entries", lambda e: e["kind"] == kind),
            lambda e: struct_of(name=e["name"], start=e["start"], stop=e["stop"]),
        ).alias("__spans"),
    )
    joined = lookups.join(spans, "file_id", "left")
    first = F.get(
        F.filter(
            "__spans",
            lambda e: (e["start"] <= F.col("line_no")) & (F.col("line_no") <= e["stop"]),
        ),
        F.lit(0),
    )
    return (
        joined.withColumn("__hit", first)
        .withColumn(kind, F.col("__hit.name"))
        .withColumn(f"{kind}_start", F.col("__hit.start"))
        .drop("__spans", "__hit")
    )


IMPORT_ADVICE = "Consider moving import to module level unless lazy loading is intentional"
DANGEROUS_ADVICE = "Avoid using dangerous functions; use safer alternatives"


def is_dangerous() -> Column:
    """Whether a function row is defined under a dangerous name."""
    hit = F.lit(False)
    for language, names in C.DANGEROUS_FUNCTIONS.items():
        hit = hit | ((F.col("language") == language) & F.col("name").isin(*names))
    return hit


def dangerous_definitions(files: DataFrame) -> DataFrame:
    """CS-AST001: functions defined under a dangerous name."""
    keys = _keys(files)
    return functions(files).filter(is_dangerous()).select(
        F.lit("security").alias("finding_type"),
        F.lit("CS-AST001").alias("rule_id"),
        F.lit("Dangerous Function Usage").alias("rule_name"),
        F.lit("high").alias("severity"),
        F.lit("medium").alias("confidence"),
        F.format_string("Potentially dangerous function '%s' detected", "name").alias("message"),
        *keys,
        F.col("start_line").alias("line_start"),
        F.col("end_line").alias("line_end"),
        F.lit(DANGEROUS_ADVICE).alias("suggestion"),
        F.lit("CWE-94").alias("cwe_id"),
        F.lit("A03").alias("owasp_category"),
    )


CALL = r"(?U)(\w+)\s*\("
# The definition's own header up to its parameters, and headers of nested ones.
DEFINED = r"(?U)^[^(]*\(|\b(?:def|class|function|func)\s+\w+"
NOT_CALLS = ("if", "for", "while", "switch", "catch", "return", "def", "class", "function",
             "with", "except", "elif", "and", "or", "not", "in", "func")


def _callees(masked: Column, entry: Column) -> Column:
    """Distinct names called inside an entry, definitions left out."""
    body = F.array_join(
        F.slice(masked, entry["start"], entry["stop"] - entry["start"] + 1), "\n"
    )
    names = F.regexp_extract_all(F.regexp_replace(body, DEFINED, ""), F.lit(CALL), 1)
    return F.array_distinct(F.filter(names, lambda n: ~n.isin(*NOT_CALLS)))


def called_names(files: DataFrame) -> DataFrame:
    return called_names_of(extract(files))


def called_names_of(extracted: DataFrame) -> DataFrame:
    """(keys..., name, start_line, callee): distinct names called in each function.

    Calls of nested functions count for the outer function as well.
    """
    keys = _keys(extracted)
    return (
        extracted.select(
            *keys, F.explode(F.filter("entries", lambda e: e["kind"] == "function")).alias("f")
        )
        .select(
            *keys, F.col("f.name").alias("name"), F.col("f.start").alias("start_line"),
            F.explode("f.callees").alias("callee"),
        )
    )


def call_edges(files: DataFrame) -> DataFrame:
    """Call edges of files; functions and their calls are written once, as all branches read them."""
    named = extract(files).select("repo_id", "path", F.transform(
        F.filter("entries", lambda e: e["kind"] == "function"),
        lambda e: struct_of(kind=e["kind"], name=e["name"], callees=e["callees"]),
    ).alias("entries"))
    store = scratch_dir(files.sparkSession, "calls")
    named.write.parquet(store)
    return call_edges_of(files.sparkSession.read.schema(named.schema).parquet(store))


def call_edges_of(extracted: DataFrame) -> DataFrame:
    """Distinct (src, dst, type) between function ids of a repository.

    A called name resolves to one definition: the file's own, else the first
    by path in the repository.  Definitions are reduced to one row per name
    before the join, so a popular name never multiplies rows.
    """
    named = extracted.select(
        "repo_id", "path",
        F.array_distinct(
            F.transform(
                F.filter("entries", lambda e: e["kind"] == "function"), lambda e: e["name"]
            )
        ).alias("own"),
        F.filter("entries", lambda e: e["kind"] == "function").alias("functions"),
    )
    first = (
        named.select("repo_id", "path", F.explode("own").alias("callee"))
        .groupBy("repo_id", "callee").agg(F.min("path").alias("__first"))
    )
    # Whether the file itself defines the name is known inside its row.
    calls = (
        named.select("repo_id", "path", "own", F.explode("functions").alias("f"))
        .select(
            "repo_id", "path", F.col("f.name").alias("name"),
            F.explode(
                F.transform(
                    "f.callees",
                    lambda c: struct_of(callee=c, local=F.array_contains("own", c)),
                )
            ).alias("c"),
        )
        .select("repo_id", "path", "name", "c.callee", "c.local")
        .distinct()
    )
    local = calls.filter("local").withColumn("__target", F.col("path"))
    other = calls.filter(~F.col("local")).join(first, ["repo_id", "callee"]).withColumnRenamed(
        "__first", "__target"
    )
    edge = lambda df: df.select(
        X.stable_id(F.col("repo_id"), F.col("path"), F.col("name")).alias("src"),
        X.stable_id(F.col("repo_id"), F.col("__target"), F.col("callee")).alias("dst"),
        F.lit("direct").alias("type"),
    )
    return edge(local).unionByName(edge(other)).distinct()
