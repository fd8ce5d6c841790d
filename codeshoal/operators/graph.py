"""The repository graph: nodes(id, label, ...) and edges(src, dst, rel, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import structure
from .upserts import latest_by

CONTAINS, DEFINES, CALLS = "CONTAINS", "DEFINES", "CALLS"


def build_index(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of repositories, files, functions, classes and calls.

    ``extracted`` is structure.extract's table, best read back from where it
    was written.  The same name twice in a file is one node: the later
    definition wins.
    """
    files = extracted
    functions = structure.functions_of(extracted)
    classes = structure.classes_of(extracted)
    calls = structure.call_edges_of(extracted)

    def node(df: DataFrame, label: str, **columns) -> DataFrame:
        empty = {
            "name": "string", "path": "string", "language": "string",
            "line_start": "int", "line_end": "int", "complexity": "int", "lines": "int",
        }
        return df.select(
            columns["id"].alias("id"), F.lit(label).alias("label"), F.col("repo_id"),
            *[
                columns.get(name, F.lit(None)).cast(kind).alias(name)
                for name, kind in empty.items()
            ],
        )

    file_id = X.stable_id(F.col("repo_id"), F.col("path"))
    member_id = X.stable_id(F.col("repo_id"), F.col("path"), F.col("name"))
    repo_nodes = node(
        files.select("repo_id").distinct(), "Repository", id=F.col("repo_id"),
        name=F.col("repo_id"),
    )
    file_nodes = node(
        files, "File", id=file_id, path=F.col("path"), language=F.col("language"),
        lines=F.col("n_lines"),
    )
    last = latest_by(
        functions, ["repo_id", "path", "name"], F.desc("start_line"), F.desc("end_line")
    )
    function_nodes = node(
        last, "Function", id=member_id, name=F.col("name"), language=F.col("language"),
        line_start=F.col("start_line"), line_end=F.col("end_line"),
        complexity=F.col("complexity"),
    )
    last_class = latest_by(
        classes, ["repo_id", "path", "name"], F.desc("start_line"), F.desc("end_line")
    )
    class_nodes = node(
        last_class, "Class", id=member_id, name=F.col("name"), language=F.col("language"),
        line_start=F.col("start_line"), line_end=F.col("end_line"),
    )
    nodes = (
        repo_nodes.unionByName(file_nodes).unionByName(function_nodes).unionByName(class_nodes)
    )

    def edge(df: DataFrame, src, dst, rel: str, kind=None) -> DataFrame:
        return df.select(
            src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"),
            (F.lit("") if kind is None else kind).alias("type"),
        )

    edges = (
        edge(files, F.col("repo_id"), file_id, CONTAINS)
        .unionByName(edge(last, file_id, member_id, DEFINES))
        .unionByName(edge(last_class, file_id, member_id, DEFINES))
        .unionByName(edge(calls, F.col("src"), F.col("dst"), CALLS, F.col("type")))
    )
    return nodes, edges


def index_counts(nodes: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: nodes, relationships and vectors of an index run."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes_created"))
    return n.withColumn(
        "relationships_created",
        edges.agg(F.count(F.lit(1)).alias("c")).scalar(),
    ).withColumn("vectors_indexed", vectors.agg(F.count(F.lit(1)).alias("c")).scalar())


def index_repository(
    files: DataFrame, store: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whole index of a set of files: nodes, edges and snippets to embed.

    With ``store`` (a folder all executors share) the parse is written there
    once and everything is derived from it, also after executors are lost;
    without it every derived table parses the files again.
    """
    extracted = structure.extract(files)
    if store is not None:
        extracted.write.mode("overwrite").parquet(store)
        extracted = files.sparkSession.read.schema(extracted.schema).parquet(store)
    nodes, edges = build_index(extracted)
    return nodes, edges, snippets_of(extracted)


def function_snippets(files: DataFrame) -> DataFrame:
    return snippets_of(structure.extract(files))


def snippets_of(extracted: DataFrame) -> DataFrame:
    """Snippet rows of functions, keyed like the vectors, last definition winning."""
    own = structure.functions_of(extracted, with_snippet=True)
    last = latest_by(own, ["repo_id", "path", "name"], F.desc("start_line"), F.desc("end_line"))
    return last.select(
        X.snippet_id(F.col("repo_id"), F.col("path"), F.col("name"), F.col("start_line"))
        .alias("id"),
        "repo_id", "path", "language",
        F.col("name").alias("function_name"),
        "start_line", "end_line",
        F.lit("function").alias("snippet_type"),
        F.col("snippet").alias("content"),
    )


# --- deletes --------------------------------------------------------------------


def delete_repository(
    nodes: DataFrame, edges: DataFrame, repo_id: str
) -> tuple[DataFrame, DataFrame]:
    """Drop a repository, what it contains, and every edge touching those."""
    root = nodes.filter((F.col("label") == "Repository") & (F.col("id") == repo_id)).select("id")
    children = (
        edges.filter((F.col("rel") == CONTAINS) & (F.col("src") == repo_id))
        .select(F.col("dst").alias("id"))
    )
    members = (
        edges.filter(F.col("rel") == DEFINES)
        .join(children.select(F.col("id").alias("src")), "src", "left_semi")
        .select(F.col("dst").alias("id"))
    )
    gone = root.unionByName(children).unionByName(members).distinct()
    kept_edges = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(
        gone.select(F.col("id").alias("dst")), "dst", "left_anti"
    )
    return nodes.join(gone, "id", "left_anti"), kept_edges


def delete_vectors(vectors: DataFrame, repo_id: str) -> DataFrame:
    return vectors.filter(F.col("repo_id") != repo_id)


# --- reads ----------------------------------------------------------------------


def contained(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Repository -> File -> Function/Class rows (member columns NULL where none)."""
    contains = edges.filter(F.col("rel") == CONTAINS).select(
        F.col("src").alias("repo_id"), F.col("dst").alias("file_id")
    )
    defines = edges.filter(F.col("rel") == DEFINES).select(
        F.col("src").alias("file_id"), F.col("dst").alias("member_id")
    )
    files = nodes.filter(F.col("label") == "File").select(
        F.col("id").alias("file_id"), "path", F.col("language"), F.col("lines")
    )
    members = nodes.filter(F.col("label").isin("Function", "Class")).select(
        F.col("id").alias("member_id"), F.col("label").alias("member_label"),
        F.col("name").alias("member_name"), F.col("complexity"),
    )
    return (
        contains.join(files, "file_id")
        .join(defines, "file_id", "left")
        .join(members, "member_id", "left")
    )


def repository_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per repository: files, lines, functions, classes, average complexity."""
    rows = contained(nodes, edges)
    # First per file, so that each file's own lines count once.
    per_file = rows.groupBy("repo_id", "file_id", "lines").agg(
        F.count_if(F.col("member_label") == "Function").alias("f"),
        F.count_if(F.col("member_label") == "Class").alias("c"),
        F.sum("complexity").alias("cc"),
    )
    return per_file.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("lines").alias("total_lines"),
        F.sum("f").alias("functions"),
        F.sum("c").alias("classes"),
        (F.sum("cc") / F.greatest(F.lit(1), F.sum("f"))).alias("average_complexity"),
    )


def language_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per repository and language: files and lines."""
    files = nodes.filter(F.col("label") == "File").select(
        F.col("id").alias("dst"), "language", "lines"
    )
    return (
        edges.filter(F.col("rel") == CONTAINS)
        .join(files, "dst")
        .groupBy(F.col("src").alias("repo_id"), "language")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))
    )


def language_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, lines): a map of language to lines; files of no known language are left out.

    One entry for each language of the catalog at most.
    """
    known = language_statistics(nodes, edges).where("language IS NOT NULL")
    return known.groupBy("repo_id").agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("language", "lines")))).alias("lines"))


def search_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose name or path contains the text, name hits scoring higher."""
    in_name = F.coalesce(F.col("name").contains(query), F.lit(False))
    in_path = F.coalesce(F.col("path").contains(query), F.lit(False))
    return nodes.filter(in_name | in_path).select(
        "id",
        F.coalesce("label", F.lit("Unknown")).alias("type"),
        F.coalesce(F.nullif("name", F.lit("")), "path", F.lit("Unknown")).alias("name"),
        F.col("path").alias("file_path"),
        "language",
        F.when(in_name, 1.0).otherwise(0.5).alias("score"),
    )


def function_neighbours(edges: DataFrame) -> DataFrame:
    """Distinct (id, direction, neighbour) of the call graph in long form."""
    calls = edges.filter(F.col("rel") == CALLS).select("src", "dst").distinct()
    return calls.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("id"), F.lit("calls").alias("direction"),
                         F.col("dst").alias("neighbour")),
                F.struct(F.col("dst").alias("id"), F.lit("called_by").alias("direction"),
                         F.col("src").alias("neighbour")),
            )
        )
    )


def function_details(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All functions with file path and numbers of distinct callees and callers.

    Neighbour ids stay in long form (function_neighbours): a hub's list has no
    bound, its count has.
    """
    functions = nodes.filter(F.col("label") == "Function")
    files = edges.filter(F.col("rel") == DEFINES).join(
        nodes.filter(F.col("label") == "File").select(
            F.col("id").alias("src"), F.col("path").alias("file_path"),
            F.col("language").alias("file_language"),
        ),
        "src",
    ).select(F.col("dst").alias("id"), "file_path", "file_language")
    degree = function_neighbours(edges).groupBy("id").agg(
        F.count_if(F.col("direction") == "calls").alias("n_calls"),
        F.count_if(F.col("direction") == "called_by").alias("n_called_by"),
    )
    return (
        functions.join(files, "id", "left")
        .join(degree, "id", "left")
        .select(
            "id", "name", "file_path", F.col("file_language").alias("language"),
            "line_start", "line_end", "complexity",
            F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
            F.coalesce("n_called_by", F.lit(0)).alias("n_called_by"),
        )
    )


def function_detail(nodes: DataFrame, edges: DataFrame, function_id: str) -> DataFrame:
    """One function with its lists of callee and caller ids."""
    neighbours = (
        function_neighbours(edges)
        .filter(F.col("id") == function_id)
        .groupBy("id")
        .agg(
            F.array_sort(
                F.collect_set(F.when(F.col("direction") == "calls", F.col("neighbour")))
            ).alias("calls"),
            F.array_sort(
                F.collect_set(F.when(F.col("direction") == "called_by", F.col("neighbour")))
            ).alias("called_by"),
        )
    )
    none = F.array().cast("array<string>")
    return (
        function_details(nodes, edges)
        .filter(F.col("id") == function_id)
        .join(neighbours, "id", "left")
        .withColumn("calls", F.coalesce("calls", none))
        .withColumn("called_by", F.coalesce("called_by", none))
    )


def reachable(
    edges: DataFrame, roots: DataFrame, depth: int = 3, salts: int = 8
) -> DataFrame:
    """(id, hop): nodes within ``depth`` calls of the roots, with their least hop.

    Each level reads the previous one once (a row yields itself and, if new,
    its neighbours), so the plan grows linearly; reduced by key each time,
    cycles do not multiply rows.  Edges are spread by a salt of their target
    and the new nodes copied to each salt, so one hub's edges are read by
    several tasks: an outer join could not be split at run time.
    """
    if not 1 <= depth <= 10:
        raise ValueError("depth is 1 to 10")
    links = edges.select(
        "src", "dst", F.pmod(F.xxhash64("dst"), F.lit(salts)).cast("int").alias("__e")
    ).distinct()
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    reached = roots.select("id", F.lit(0).alias("hop")).distinct()
    for level in range(depth):
        fresh = F.col("hop") == level
        spread = reached.select(
            "id", "hop", F.explode(F.when(fresh, every).otherwise(F.array(F.lit(0)))).alias("__s")
        )
        expanded = spread.join(
            links,
            (F.col("id") == F.col("src")) & (F.col("__s") == F.col("__e")) & fresh, "left",
        ).select(
            F.inline(
                F.array_compact(
                    F.array(
                        F.struct(F.col("id"), F.col("hop")),
                        F.when(
                            F.col("dst").isNotNull(),
                            F.struct(F.col("dst").alias("id"), F.lit(level + 1).alias("hop")),
                        ),
                    )
                )
            )
        )
        reached = expanded.groupBy("id").agg(F.min("hop").alias("hop"))
    return reached


def reachable_edges(edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """Distinct edges on call paths of at most ``depth`` steps from the roots."""
    inner = reachable(edges, roots, depth).filter(F.col("hop") < depth)
    return (
        edges.join(inner.select(F.col("id").alias("src")), "src", "left_semi")
        .select("src", "dst", "type")
        .distinct()
    )


def first_paths(
    edges: DataFrame, root, depth: int = 3, limit: int = 100
) -> DataFrame:
    """The first call paths from a root in the order of their node lists.

    Prefixes of a kept path sort before it, so keeping the first ``limit``
    paths at every level is exact.  The kept paths, never more than that, are
    broadcast to the edges level by level.  No edge is used twice in a path.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    schema = f"path array<{kind}>"
    kept = [[root]]
    for level in range(1, depth + 1):
        longest = [(p,) for p in kept if len(p) == level]
        if not longest:
            break
        steps = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))),
            lambda i: F.struct(
                F.element_at("path", i).alias("a"), F.try_element_at("path", i + 1).alias("b")
            ),
        )
        used = F.exists(steps, lambda e: (e["a"] == F.col("src")) & (e["b"] == F.col("dst")))
        longer = (
            edges.select("src", "dst")
            .join(
                F.broadcast(spark.createDataFrame(longest, schema)),
                F.col("src") == F.element_at("path", -1),
            )
            .filter(~F.coalesce(used, F.lit(False)))
            .select(F.concat("path", F.array("dst")).alias("path"))
            .distinct()
            .orderBy("path")
            .limit(limit)
        )
        found = [list(r["path"]) for r in longer.collect()]
        kept = sorted(kept + found)[: limit + 1]
    return spark.createDataFrame([(p,) for p in kept if len(p) > 1], schema)


def list_repositories(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("label") == "Repository")
