"""Text functions on source code: Column in, Column out, all JVM-side.

Patterns carry ``(?d)`` so only ``\\n`` ends a line, and ``(?U)`` where ``\\w``
or ``\\s`` must cover Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalogs as C


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace, Unicode included."""
    return F.btrim(text, F.lit(C.WHITESPACE))


def split_lines(content: Column) -> Column:
    """Lines as an array; a trailing newline yields a trailing empty line."""
    return F.split(content, "\n", -1)


def content_hash(content: Column) -> Column:
    return F.md5(content)


def stable_id(*parts: Column) -> Column:
    """md5 of the parts joined by ':'."""
    return F.md5(F.concat_ws(":", *parts))


def snippet_id(repo: Column, path: Column, name: Column, start_line: Column) -> Column:
    """Snippet key: the function name, or the start line where there is none."""
    label = F.coalesce(F.nullif(name, F.lit("")), start_line.cast("string"))
    return stable_id(repo, path, label)


def normalize_code(content: Column, language: Column) -> Column:
    """Drop comments and triple-quoted strings, trim lines, drop blank lines."""
    hashes = F.regexp_replace(content, r"(?dm)#.*$", "")
    slashes = F.regexp_replace(content, r"(?dm)//.*$", "")
    text = (
        F.when(language.isin(*C.HASH_COMMENT_LANGUAGES), hashes)
        .when(language.isin(*C.SLASH_COMMENT_LANGUAGES), slashes)
        .otherwise(content)
    )
    for pattern in (r"(?s)/\*.*?\*/", r'(?s)""".*?"""', r"(?s)'''.*?'''"):
        text = F.regexp_replace(text, pattern, "")
    kept = F.filter(F.transform(split_lines(text), strip), lambda line: line != "")
    return F.array_join(kept, "\n")


# Import patterns that must match as they stand.
PYTHON_IMPORT = r"^\s*(?:from\s+(\S+)\s+)?import\s+(.+)$"
ES_IMPORT = r"""import\s+.*?\s+from\s+['"]([^'"]+)['"]"""
REQUIRE = r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
JAVA_IMPORT = r"^\s*import\s+([^;]+);"
GO_IMPORT = r"""^\s*import\s+["']([^"']+)["']"""


def extract_imports(content: Column, language: Column) -> Column:
    """Imported names as an array of strings, in order of appearance."""
    def every(pattern: str, group: int, flags: str = "(?dmU)") -> Column:
        return F.regexp_extract_all(content, F.lit(flags + pattern), group)

    python = F.zip_with(
        every(PYTHON_IMPORT, 1),
        every(PYTHON_IMPORT, 2),
        lambda module, names: F.when(module != "", F.concat(module, F.lit("."), names))
        .otherwise(names),
    )
    scripts = F.concat(every(ES_IMPORT, 1, "(?dU)"), every(REQUIRE, 1, "(?dU)"))
    return (
        F.when(language == "python", python)
        .when(language.isin("javascript", "typescript"), scripts)
        .when(language == "java", every(JAVA_IMPORT, 1))
        .when(language == "go", every(GO_IMPORT, 1))
        .otherwise(F.array().cast("array<string>"))
    )


def count_lines(content: Column) -> Column:
    """Struct (total, code, comment): one fold over the lines.

    The state is two counters and a bit saying that a block comment is open.
    A line that opens a block sets the bit even if it also closes it.
    """
    zero = F.struct(
        F.lit(0).alias("code"), F.lit(0).alias("comment"), F.lit(False).alias("open")
    )

    def step(state: Column, line: Column) -> Column:
        text = strip(line)
        closes = text.contains("*/") | text.contains('"""') | text.contains("'''")
        single = text.startswith("#") | text.startswith("//") | text.startswith("*")
        opens = text.startswith("/*") | text.startswith('"""') | text.startswith("'''")
        blank = text == ""
        comment = ~blank & (state["open"] | single | opens)
        return F.struct(
            (state["code"] + F.when(~blank & ~comment, 1).otherwise(0)).alias("code"),
            (state["comment"] + F.when(comment, 1).otherwise(0)).alias("comment"),
            F.when(blank, state["open"])
            .when(state["open"], ~closes)
            .otherwise(~single & opens)
            .alias("open"),
        )

    lines = split_lines(content)
    counted = F.aggregate(lines, zero, step)
    return F.struct(
        F.size(lines).alias("total"),
        counted["code"].alias("code"),
        counted["comment"].alias("comment"),
    )


def truncate_code(content: Column, max_lines: int = 50, max_chars: int = 5000) -> Column:
    """Cut to a number of lines, then of characters, marking each cut."""
    marker = "... [truncated]"
    lines = split_lines(content)
    cut = F.when(
        F.size(lines) > max_lines,
        F.concat(F.array_join(F.slice(lines, 1, max_lines), "\n"), F.lit("\n" + marker)),
    ).otherwise(content)
    return F.when(
        F.length(cut) > max_chars, F.concat(F.left(cut, F.lit(max_chars)), F.lit("\n" + marker))
    ).otherwise(cut)


def sanitize_filename(name: Column) -> Column:
    return F.left(F.regexp_replace(name, r"(?U)[^\w\-.]", "_"), F.lit(255))


def parse_git_url(url: Column) -> Column:
    """Struct (provider, owner, repo, protocol); missing parts are NULL."""
    web = url.startswith("https://") | url.startswith("http://")
    ssh = url.startswith("git@")
    web_parts = F.split(
        F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")),
        "/", -1,
    )
    ssh_parts = F.split(F.replace(url, F.lit("git@"), F.lit("")), ":", -1)
    ssh_path = F.split(F.get(ssh_parts, F.lit(1)), "/", -1)
    plain = lambda name: F.replace(name, F.lit(".git"), F.lit(""))
    long_web = web & (F.size(web_parts) >= 3)
    long_ssh = ssh & (F.size(ssh_parts) >= 2)
    full_ssh = long_ssh & (F.size(ssh_path) >= 2)
    return F.struct(
        F.when(long_web, F.get(web_parts, F.lit(0)))
        .when(long_ssh, F.get(ssh_parts, F.lit(0))).alias("provider"),
        F.when(long_web, F.get(web_parts, F.lit(1)))
        .when(full_ssh, F.get(ssh_path, F.lit(0))).alias("owner"),
        F.when(long_web, plain(F.get(web_parts, F.lit(2))))
        .when(full_ssh, plain(F.get(ssh_path, F.lit(1)))).alias("repo"),
        F.when(web, F.lit("https")).when(ssh, F.lit("ssh")).alias("protocol"),
    )


def repo_name(url: Column) -> Column:
    """Last segment of a repository URL without '.git'."""
    trimmed = F.regexp_replace(url, "/+$", "")
    return F.replace(F.substring_index(trimmed, "/", -1), F.lit(".git"), F.lit(""))


def snippet(content: Column, start_line: Column, end_line: Column) -> Column:
    """Lines start..end (1-based, inclusive) of a file."""
    length = F.greatest(end_line - start_line + 1, F.lit(0))
    return F.array_join(F.slice(split_lines(content), start_line, length), "\n")


def external_severity(level: Column) -> Column:
    """Severity of an external scanner level, medium when unknown."""
    upper = F.upper(level)
    expr = None
    for k, v in C.EXTERNAL_SEVERITY.items():
        expr = F.when(upper == k, F.lit(v)) if expr is None else expr.when(upper == k, F.lit(v))
    return expr.otherwise(F.lit("medium"))


def severity_rank(severity: Column) -> Column:
    """1 for critical up to 5 for info; 0 for anything else."""
    return F.array_position(F.array(*[F.lit(s) for s in C.SEVERITIES]), severity).cast("int")


def embedding_text(text: Column) -> Column:
    """Text handed to the encoder: its first 5000 characters, as specified."""
    return F.left(text, F.lit(5000))


def apply_stops(text: Column, stops: list[str]) -> Column:
    """Cut at each stop in turn, every stop seeing the already cut text."""
    for stop in stops:
        text = F.substring_index(text, stop, 1)
    return text


def client_key(user: Column, forwarded: Column, host: Column) -> Column:
    """Rate-limit key: user, else first forwarded address, else host."""
    first = strip(F.get(F.split(forwarded, ",", -1), F.lit(0)))
    return F.when(
        F.coalesce(user, F.lit("")) != "", F.concat(F.lit("user:"), user)
    ).otherwise(
        F.concat(
            F.lit("ip:"),
            F.when(F.coalesce(forwarded, F.lit("")) != "", first)
            .otherwise(F.coalesce(host, F.lit("unknown"))),
        )
    )


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two timestamps."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return (micros / F.lit(1000)).cast("bigint")


def format_chat(messages: Column) -> Column:
    """Concatenate '<|role|>content' over messages; role defaults to user."""
    return F.array_join(
        F.transform(
            messages,
            lambda m: F.concat(
                F.lit("<|"), F.coalesce(m["role"], F.lit("user")), F.lit("|>"),
                F.coalesce(m["content"], F.lit("")),
            ),
        ),
        "",
    )


def format_instruction(instruction: Column, input_text: Column, output: Column) -> Column:
    """Instruction / optional Input / Response sections."""
    empty = F.lit("")
    given = F.coalesce(input_text, empty)
    return F.concat(
        F.lit("### Instruction:\n"), F.coalesce(instruction, empty), F.lit("\n"),
        F.when(given != "", F.concat(F.lit("### Input:\n"), given, F.lit("\n"))).otherwise(empty),
        F.lit("### Response:\n"), F.coalesce(output, empty),
    )
