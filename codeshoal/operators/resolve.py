"""What a call names: definitions found through a file's own scope and through imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.bind import let, struct_of
from ..session import scratch_dir
from .structure import DEFINED, NOT_CALLS, mask, parse

# A call with what stands before its dots; a leading dot follows an expression.
DOTTED_CALL = r"(?U)(\.?(?:\w+\s*\.\s*)*\w+)\s*\("
SELF = ("self", "cls", "this")
PY_FROM = r"(?Um)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+(\([^)]*\)|[^\n;#]+)"
PY_IMPORT = r"(?Um)^[ \t]*import[ \t]+([^\n;#]+)"
JS_FROM = r"""(?m)^[ \t]*(?:import|export)\s+([^;'"]*?)\s*\bfrom\s*['"]([^'"\n]+)['"]"""
EXTENSION = r"\.(?:py|pyi|js|jsx|mjs|cjs|ts|tsx)$"
BINDING = "array<struct<alias:string,module:string,symbol:string>>"


def _named(listed: Column) -> Column:
    """(name, alias) of each entry of an import list."""
    bare = F.regexp_replace(listed, r"(?m)[(){}]|#.*$", " ")
    entries = F.filter(F.transform(F.split(bare, ",", -1), X.strip), lambda n: n != "")
    return F.transform(entries, lambda n: struct_of(
        name=F.regexp_extract(n, r"(?U)^([\w.$*]+)", 1),
        alias=F.coalesce(F.nullif(F.regexp_extract(n, r"(?U)\sas\s+([\w$]+)$", 1), F.lit("")),
                         F.regexp_extract(n, r"(?U)^([\w.$*]+)", 1))))


def _pairs(text: Column, pattern: str, first: int, second: int) -> Column:
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(first)).alias("a"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(second)).alias("b"))


def _joined(folder: Column, relative: Column) -> Column:
    """A path below the root from a folder and a relative one with '.' and '..' in it."""
    return F.concat(F.lit("/"), F.array_join(F.aggregate(
        F.concat(F.split(folder, "/"), F.split(relative, "/")), F.array().cast("array<string>"),
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part)))), "/"))


def bindings(files: DataFrame) -> DataFrame:
    """(repo_id, path, alias, module, symbol): names that imports bind in a file.

    ``module`` is '/' and a path without extension for relative imports, else dotted names.
    ``symbol`` is null where the alias is the module itself, and '*' where everything comes.
    """
    folder = F.regexp_extract(F.col("path"), r"^(.*)/[^/]*$", 1)

    def python_module(written: Column) -> Column:
        dots = F.length(F.regexp_extract(written, r"^(\.*)", 1))
        rest = F.replace(F.regexp_replace(written, r"^\.+", ""), F.lit("."), F.lit("/"))
        up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
        return F.when(dots > 0, _joined(folder, F.concat(up, rest))).otherwise(written)

    def from_python(text: Column) -> Column:
        listed = F.flatten(F.transform(_pairs(text, PY_FROM, 1, 2), lambda p: F.transform(
            _named(p["b"]), lambda n: struct_of(
                alias=n["alias"], module=python_module(p["a"]), symbol=n["name"]))))
        whole = F.flatten(F.transform(
            F.regexp_extract_all(text, F.lit(PY_IMPORT), F.lit(1)), lambda m: F.transform(
                _named(m), lambda n: struct_of(
                    alias=n["alias"], module=n["name"], symbol=F.lit(None).cast("string")))))
        return F.concat(listed.cast(BINDING), whole.cast(BINDING))

    def from_script(text: Column) -> Column:
        def bound(pair: Column) -> Column:
            module = F.when(pair["b"].startswith("."), F.regexp_replace(F.regexp_replace(
                _joined(folder, pair["b"]), EXTENSION, ""), "/index$", "")).otherwise(pair["b"])
            braces = F.regexp_extract(pair["a"], r"\{([^}]*)\}", 1)
            plain = F.regexp_replace(pair["a"], r"\{[^}]*\}", "")
            space = F.regexp_extract(plain, r"\*\s*as\s+([\w$]+)", 1)
            default = F.regexp_extract(plain, r"^\s*([\w$]+)\s*(?:,|$)", 1)
            none = F.array().cast(BINDING)

            def one(alias: Column, symbol: Column, when: Column) -> Column:
                return F.when(when, F.array(struct_of(
                    alias=alias, module=module, symbol=symbol)).cast(BINDING)).otherwise(none)

            return F.concat(
                F.transform(_named(braces), lambda n: struct_of(
                    alias=n["alias"], module=module, symbol=n["name"])).cast(BINDING),
                one(space, F.lit(None).cast("string"), space != ""),
                one(F.lit("*"), F.lit("*"), X.strip(plain) == "*"),
                one(default, default, default != ""))

        return F.flatten(F.transform(_pairs(text, JS_FROM, 1, 2), bound))

    language = F.col("language")
    found = F.when(language == "python", let(mask(F.col("content"), language), from_python)).when(
        language.isin("javascript", "typescript"), from_script(F.col("content")))
    return files.where(language.isin("python", "javascript", "typescript")).select(
        "repo_id", "path", F.inline(found))


def modules(files: DataFrame) -> DataFrame:
    """(repo_id, module, file): which file an import of ``module`` means.

    A file is known by its whole path, and to Python by every dotted ending of it; among files
    of the same ending the shortest path counts, then the first.
    """
    bare = F.regexp_replace(F.regexp_replace(F.col("path"), EXTENSION, ""), r"/(?:__init__|index)$", "")
    parts = F.split(bare, "/")
    endings = F.transform(
        F.sequence(F.lit(1), F.size("parts")),
        lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "."))
    known = files.where(F.col("language").isin("python", "javascript", "typescript")).select(
        "repo_id", "path", "language", F.explode(F.array(parts)).alias("parts"))
    names = F.concat(
        F.array(F.concat(F.lit("/"), F.array_join("parts", "/"))),
        F.when(F.col("language") == "python", endings).otherwise(F.array().cast("array<string>")))
    return known.select("repo_id", "path", F.explode(names).alias("module")).groupBy(
        "repo_id", "module").agg(F.min(F.struct(F.length("path"), "path"))["path"].alias("file"))


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _followed(links: DataFrame) -> DataFrame:
    """Each link (repo_id, path, name, to_path, to_name) to the end of its chain.

    Every round doubles how far a link reaches, so a chain of n re-exports takes log n rounds.
    Links that run in a circle lead nowhere and are left out.
    """
    links = _written(links, "links")
    rounds = max(1, links.count()).bit_length() + 1
    ahead = [F.col(c).alias(a) for c, a in (
        ("repo_id", "repo_id"), ("path", "to_path"), ("name", "to_name"), ("to_path", "next_path"),
        ("to_name", "next_name"))]
    keys = ["repo_id", "to_path", "to_name"]
    for _ in range(rounds):
        stepped = _written(links.join(links.select(*ahead), keys, "left"), "links")
        if not stepped.where("next_path IS NOT NULL").limit(1).count():
            break
        links = stepped.select(
            "repo_id", "path", "name", F.coalesce("next_path", "to_path").alias("to_path"),
            F.when(F.col("next_path").isNull(), F.col("to_name")).otherwise(F.col("next_name"))
            .alias("to_name"))
        links = _written(links, "links")
    return links.join(links.select(*ahead), keys, "left_anti").select(
        "repo_id", "path", "name", "to_path", "to_name")


def _calls(files: DataFrame) -> DataFrame:
    """(repo_id, path, own, name, call): distinct dotted calls of each function."""
    def complete(lines: Column) -> Column:
        def called(e: Column) -> Column:
            body = F.array_join(F.slice(lines, e["start"], e["stop"] - e["start"] + 1), "\n")
            found = F.regexp_extract_all(
                F.regexp_replace(body, DEFINED, ""), F.lit(DOTTED_CALL), F.lit(1))
            tight = F.transform(found, lambda n: F.regexp_replace(n, r"\s+", ""))
            return F.array_distinct(F.filter(tight, lambda n: ~n.isin(*NOT_CALLS)))

        return F.transform(F.filter("entries", lambda e: e["kind"] == "function"), lambda e:
                           struct_of(name=e["name"], calls=called(e)))

    masked = F.coalesce(mask(F.col("content"), F.col("language")), F.lit(""))
    own = F.array_distinct(F.transform(
        F.filter("entries", lambda e: e["kind"] == "function"), lambda e: e["name"]))
    return parse(files).select(
        "repo_id", "path", own.alias("own"),
        F.explode(let(X.split_lines(masked), complete)).alias("f")
    ).select("repo_id", "path", "own", F.col("f.name").alias("name"), F.explode("f.calls").alias("call"))


def resolved_calls(files: DataFrame) -> DataFrame:
    """(repo_id, path, name, call, target_path, target_name, how), distinct.

    A plain name means the file's own function of that name (``how`` is 'own'), also after ``self``;
    else what an import binds it to, followed through re-exports to its definition
    ('import'); so does a name after an imported module.  Any other call, such as a method
    of a value, goes to the file's own or else the repository's first function of that name and
    is marked 'guess'; names that nothing defines give no row.  Python and JavaScript.
    """
    calls = _written(_calls(files).distinct(), "calls")
    defs = _written(parse(files).select("repo_id", "path", F.explode(F.filter(
        "entries", lambda e: e["kind"] == "function")).alias("e")).select(
        "repo_id", "path", F.col("e.name").alias("name")).distinct(), "definitions")
    known = _written(modules(files), "modules")
    bound = _written(bindings(files).distinct(), "bindings")
    target = known.select("repo_id", "module", F.col("file").alias("to_path"))
    placed = bound.join(target, ["repo_id", "module"], "left")
    # `from package import module` binds a module where there is one of that name.
    glue = F.when(F.col("module").startswith("/"), F.lit("/")).otherwise(F.lit("."))
    inner = F.when(F.col("symbol").isNotNull() & (F.col("symbol") != "*"),
                   F.regexp_replace(F.concat("module", glue, "symbol"), "^//", "/"))
    placed = _written(placed.withColumn("inner", inner).join(
        known.select("repo_id", F.col("module").alias("inner"), F.col("file").alias("inner_path")),
        ["repo_id", "inner"], "left"), "placed")
    spaces = placed.select("repo_id", "path", "alias", F.when(
        F.col("symbol").isNull(), F.col("to_path")).otherwise(F.col("inner_path")).alias("space")
    ).where("space IS NOT NULL").groupBy("repo_id", "path", "alias").agg(F.min("space").alias("space"))
    named = placed.where("symbol IS NOT NULL AND symbol <> '*' AND to_path IS NOT NULL").select(
        "repo_id", "path", F.col("alias").alias("name"), "to_path", F.col("symbol").alias("to_name"))
    stars = placed.where("symbol = '*' AND to_path IS NOT NULL").select("repo_id", "path", "to_path")
    given = defs.select("repo_id", F.col("path").alias("to_path"), "name").unionByName(
        named.select("repo_id", F.col("path").alias("to_path"), "name")).distinct()
    starred = stars.join(given, ["repo_id", "to_path"]).select(
        "repo_id", "path", "name", "to_path", F.col("name").alias("to_name"))
    links = named.withColumn("star", F.lit(False)).unionByName(
        starred.withColumn("star", F.lit(True))).join(
        defs, ["repo_id", "path", "name"], "left_anti").groupBy("repo_id", "path", "name").agg(
        F.min(F.struct("star", "to_path", "to_name")).alias("t")).select(
        "repo_id", "path", "name", "t.to_path", "t.to_name").where(
        ~((F.col("path") == F.col("to_path")) & (F.col("name") == F.col("to_name"))))
    ends = _written(_followed(links).join(defs.select(
        "repo_id", F.col("path").alias("to_path"), F.col("name").alias("to_name")),
        ["repo_id", "to_path", "to_name"], "left_semi"), "ends")

    last = F.regexp_extract("call", r"(?U)\w+$", 0)
    before = F.regexp_replace("call", r"(?U)\.?\w+$", "")
    asked = calls.withColumn("last", last).withColumn("before", before).withColumn(
        "plain", ~F.contains("call", F.lit(".")) | F.col("before").isin(*SELF))
    own = asked.where("plain AND array_contains(own, last)").select(
        "repo_id", "path", "name", "call", F.col("path").alias("target_path"),
        F.col("last").alias("target_name"), F.lit("own").alias("how"))
    # The scope in which the last name is looked up: the file, or the module before the dot.
    scoped = asked.where("NOT (plain AND array_contains(own, last))").join(
        spaces.select("repo_id", "path", F.col("alias").alias("before"), "space"),
        ["repo_id", "path", "before"], "left").withColumn(
        "scope", F.when(F.col("plain"), F.col("path")).otherwise(F.col("space")))
    through = ends.select("repo_id", F.col("path").alias("scope"), F.col("name").alias("last"),
                          "to_path", "to_name").unionByName(
        defs.select("repo_id", F.col("path").alias("scope"), F.col("name").alias("last"),
                    F.col("path").alias("to_path"), F.col("name").alias("to_name")))
    first = defs.groupBy("repo_id", F.col("name").alias("last")).agg(F.min("path").alias("first"))
    rest = scoped.join(through, ["repo_id", "scope", "last"], "left").join(
        first, ["repo_id", "last"], "left").select(
        "repo_id", "path", "name", "call",
        F.coalesce("to_path", F.when(F.array_contains("own", F.col("last")), F.col("path")), "first")
        .alias("target_path"),
        F.when(F.col("to_path").isNull(), F.col("last")).otherwise(F.col("to_name"))
        .alias("target_name"),
        F.when(F.col("to_path").isNull(), F.lit("guess")).otherwise(F.lit("import")).alias("how"),
    ).where("target_path IS NOT NULL")
    return own.unionByName(rest)
