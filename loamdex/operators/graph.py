"""A property graph as tables of nodes (id, type, label) and edges (src, dst, type)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.session import cut, small

HIERARCHY = "contains"
MOST_DEPTH = 10


def page_graph(pages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of pages: hosts contain folders, folders contain pages, pages link to targets, known or not."""
    bare = bare_path(F.col("url"))
    parts = F.split(bare, "/")
    placed = pages.select("page_id", bare.alias("path"), parts.alias("s"))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1))), lambda n: F.array_join(F.slice("s", F.lit(1), n), "/"))
    chain = placed.select("page_id", "path", prefixes.alias("folders"))
    folder = chain.select(F.explode("folders").alias("f")).distinct().select(F.concat(F.lit("dir:"), "f").alias("id"), F.lit("directory").alias("type"), F.element_at(F.split("f", "/"), -1).alias("label"))
    page = placed.select(F.concat(F.lit("page:"), "path").alias("id"), F.lit("page").alias("type"), F.element_at("s", -1).alias("label")).distinct()
    inside = chain.select(F.explode(F.zip_with(F.slice("folders", F.lit(1), F.size("folders") - 1), F.slice("folders", F.lit(2), F.size("folders")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    inside = inside.filter("p.b is not null").select(F.concat(F.lit("dir:"), "p.a").alias("src"), F.concat(F.lit("dir:"), "p.b").alias("dst"), F.lit(HIERARCHY).alias("type")).distinct()
    holds = chain.select(F.concat(F.lit("dir:"), F.element_at("folders", -1)).alias("src"), F.concat(F.lit("page:"), "path").alias("dst"), F.lit(HIERARCHY).alias("type")).distinct()
    target = links.join(pages.select("page_id", F.col("url").alias("from_url")), "page_id").select("from_url", resolved(F.col("from_url"), F.col("target")).alias("t"))
    refers = target.select(F.concat(F.lit("page:"), bare_path(F.col("from_url"))).alias("src"), F.concat(F.lit("page:"), "t").alias("dst"), F.lit("links_to").alias("type")).distinct()
    outside = refers.select(F.col("dst").alias("id")).distinct().join(page.select("id"), "id", "left_anti").select("id", F.lit("external_reference").alias("type"), F.regexp_replace("id", "^page:", "").alias("label"))
    return folder.unionByName(page).unionByName(outside), inside.unionByName(holds).unionByName(refers)


def bare_path(url: Column) -> Column:
    """Host and path of a URL, without scheme, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), "[?#].*$", "")


def resolved(base: Column, target: Column) -> Column:
    """A link's target as host and path: absolute, from the host's root, or beside the page."""
    host = F.regexp_extract(base, "^[a-z]+://([^/]+)", 1)
    beside = F.regexp_replace(bare_path(base), "[^/]*$", "")
    return (
        F.when(target.rlike("^[a-z]+://"), F.regexp_replace(target, "^[a-z]+://", ""))
        .when(target.startswith("/"), F.concat(host, target))
        .otherwise(F.concat(beside, F.regexp_replace(target, "^(\\./)+", "")))
    )


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): both ends of every edge count, parallel edges each."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges).select("id"), "id", "left_anti")


def diagnostics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, links, orphans, largest degree and links a node, rounded to three digits."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("links"))
    most = degrees(edges).agg(F.max("degree").alias("hub_degree"))
    alone = orphans(nodes, edges).agg(F.count(F.lit(1)).alias("orphans"))
    return n.crossJoin(m).crossJoin(most).crossJoin(alone).withColumn("density", F.round(F.try_divide(F.col("links"), F.col("nodes")), 3))  # one row each


def fold(rows: DataFrame, *columns: str) -> DataFrame:
    """One row (n, fold): the count and an order-free digest of rows that adding or taking a row changes reversibly."""
    number = F.conv(F.substring(T.digest(*[F.col(c) for c in columns]), 1, 15), 16, 10).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(number).alias("fold"))


def delta(before: DataFrame, after: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, change) of rows that were added, removed or changed in the named columns."""
    mark = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias(name))
    both = mark(before, "a").join(mark(after, "b"), key, "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")


def frontier(edges: DataFrame, per_source: int, first: tuple[str, ...] = (HIERARCHY,)) -> DataFrame:
    """(src, dst, place): each source's targets, those with an edge of a first type before others, at most so many."""
    pairs = edges.groupBy("src", "dst").agg(F.min(F.when(F.col("type").isin(*first), 0).otherwise(1)).alias("group"))
    place = F.dense_rank().over(Window.partitionBy("src").orderBy("group", "dst"))
    return pairs.withColumn("place", place).filter(F.col("place") <= per_source).select("src", "dst", "place")


def neighbours(edges: DataFrame, starts: DataFrame, depth: int = 1, edge_types: tuple[str, ...] = (), budget: int | None = None) -> DataFrame:
    """(start, id, depth, parent) by breadth first from every start at once: hierarchy before other edges, first sighting wins.

    The frontier of all starts is one table, joined with the edges once a level, up to ``depth`` (ten at
    most). ``budget`` bounds the nodes of each start, itself included, in the order in which they are seen.
    """
    used = edges.filter(F.col("type").isin(*edge_types)) if edge_types else edges
    # made once, as every level reads it
    pairs = cut(used.groupBy("src", "dst").agg(F.min(F.when(F.col("type") == HIERARCHY, 0).otherwise(1)).alias("group")), "graph-pairs")
    none = F.lit(None).cast("string")
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"), none.alias("parent"), F.lit(1).cast("long").alias("pos")).distinct()
    last = seen
    for level in range(1, max(1, min(depth, MOST_DEPTH)) + 1):
        step = last.select("start", F.col("id").alias("src"), F.col("pos").alias("from_pos")).join(pairs, "src")
        fresh = step.select("start", F.col("dst").alias("id"), "src", "from_pos", "group").join(seen.select("start", "id"), ["start", "id"], "left_anti")
        best = fresh.groupBy("start", "id").agg(F.min(F.struct("from_pos", "group", "src")).alias("m")).select("start", "id", "m.*")
        counted = seen.groupBy("start").agg(F.max("pos").alias("so_far"))
        order = Window.partitionBy("start").orderBy("from_pos", "group", "id")
        placed = best.withColumn("row", F.row_number().over(order)).join(counted, "start")
        placed = placed.select("start", "id", F.lit(level).alias("depth"), F.col("src").alias("parent"), (F.col("row") + F.col("so_far")).alias("pos"))
        if budget is not None:
            placed = placed.filter(F.col("pos") <= budget)
        last = cut(placed, "frontier")
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen.select("start", "id", "depth", "parent", "pos")


def subgraph(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 1, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, edges among them) around one node; one node beyond the limit marks that more is there."""
    spark = nodes.sparkSession
    around = neighbours(edges, spark.createDataFrame([(start,)], "id string"), depth, budget=limit + 1)
    held = nodes.join(around.select("id", "depth", "pos"), "id")
    inside = held.select("id")
    linked = edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return held, linked


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 8) -> DataFrame:
    """(src, dst, hops) of pairs (src, dst) along edges in either direction, no row beyond ``depth``.

    All pairs are walked at once from the ends of which there are fewer, a level at a time: a start goes on while a pair of
    it is open. Edges go both ways, so what a level reaches lies in it or in the levels next to it, and only those are kept apart.
    """
    ends = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = cut(ends.withColumnRenamed("src", "id").distinct(), "graph-both-ways")
    pairs = cut(pairs.select("src", "dst").filter("src is not null and dst is not null").distinct(), "path-pairs")
    count = pairs.agg(F.countDistinct("src").alias("src"), F.countDistinct("dst").alias("dst")).first()
    start, goal = ("src", "dst") if count["src"] <= count["dst"] else ("dst", "src")
    left = pairs.select(F.col(start).alias("start"), F.col(goal).alias("id"))
    before = last = left.select("start", F.col("start").alias("id")).distinct()
    found = None
    for level in range(depth + 1):
        if level:
            step = last.join(left.select("start").distinct(), "start", "left_semi").join(both, "id").select("start", F.col("dst").alias("id")).distinct()
            before, last = last, cut(step.join(before.unionByName(last), ["start", "id"], "left_anti"), "frontier")
        met = left.join(last, ["start", "id"], "left_semi").withColumn("hops", F.lit(level))
        found = met if found is None else found.unionByName(met)
        left = cut(left.join(last, ["start", "id"], "left_anti"), "open-pairs")
        if left.isEmpty():
            break
    return found.select(F.col("start").alias(start), F.col("id").alias(goal), "hops").select("src", "dst", "hops")


def suffix_references(references: DataFrame, paths: DataFrame) -> DataFrame:
    """(ref, path) where a reference is a path's ending at a folder: endings are listed, so the join is on equality."""
    parts = F.split("path", "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    listed = paths.select("path", F.explode(endings).alias("ending"))
    return references.select("ref", F.regexp_replace(F.regexp_replace("ref", "[#?].*$", ""), "^[./]+", "").alias("ending")).join(listed, "ending").select("ref", "path").distinct()


def resolve_links(references: DataFrame, paths: DataFrame) -> DataFrame:
    """(ref, path, step): the file that a link means: its own path, with .md or .txt where it has no dot, or else a path that ends with it.

    The first step that finds a path wins, then the least path. Fragments, queries and leading dots and slashes don't count.
    """
    refs = references.select("ref").distinct().withColumn("c", F.regexp_replace(F.regexp_replace("ref", "[#?].*$", ""), "^[./]+", ""))
    bare = ~F.contains("c", F.lit("."))
    tries = F.array(F.struct(F.lit(1).alias("step"), F.col("c").alias("path")), *[F.struct(F.lit(n).alias("step"), F.when(bare, F.concat("c", F.lit(end))).alias("path")) for n, end in ((2, ".md"), (3, ".txt"))])
    exact = refs.select("ref", F.explode(tries).alias("t")).select("ref", "t.step", "t.path").join(paths.select("path").distinct(), "path")
    ending = suffix_references(refs.select("ref"), paths).select("path", "ref", F.lit(4).alias("step"))
    found = exact.select("path", "ref", "step").unionByName(ending)
    return found.groupBy("ref").agg(F.min(F.struct("step", "path")).alias("m")).select("ref", "m.path", "m.step")


def ladder(asked: DataFrame, rungs: list[tuple[str, DataFrame, float]], most: int = 3) -> DataFrame:
    """(label, id, rung, confidence): what a label names, from the first of (name, (label, id), confidence) that knows it, ``most`` ids at most by id."""
    known = None
    for n, (name, rows, confidence) in enumerate(rungs):
        part = rows.select("label", "id", F.lit(n).alias("n"), F.lit(name).alias("rung"), F.lit(confidence).alias("confidence")).distinct()
        known = part if known is None else known.unionByName(part)
    met = asked.select("label").distinct().join(known, "label")
    first = met.groupBy("label").agg(F.min("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    return met.join(first, ["label", "n"]).withColumn("place", place).filter(F.col("place") <= most).select("label", "id", "rung", "confidence")


def parallel(edges: DataFrame) -> DataFrame:
    """(src, dst, links, types): edges of the same ends as one row, with their types in order."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def node_link(nodes: DataFrame, edges: DataFrame, node_limit: int | None = None, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes after filtering, then the limit, by id; edges both of whose ends are among them."""
    kept = nodes.filter(~F.col("type").isin(*exclude)) if exclude else nodes
    kept = kept.orderBy("id").limit(node_limit) if node_limit is not None else kept
    ids = kept.select("id")
    return kept, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def with_bag(rows: DataFrame, promoted: tuple[str, ...]) -> DataFrame:
    """``rows`` with the promoted columns as they are and all others as one JSON object, bag; null values are left out of it."""
    return rows.select(*promoted, F.to_json(F.struct(*[c for c in rows.columns if c not in promoted])).alias("bag"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]{2,}"), F.lit(0))


def rung(low: str, q: str, tokens: list[str], steps: tuple[float, float, float]) -> float:
    """How well a lower-cased field fits a query: it is the query, holds it (the mean of whole and every), holds all tokens, any, or none."""
    whole, every, some = steps
    if low == q:
        return whole
    if q in low:
        return (whole + every) / 2
    if all(t in low for t in tokens):
        return every
    return some if any(t in low for t in tokens) else 0.0


def _best_rungs(pairs: DataFrame, tokens: DataFrame, fields: dict[str, tuple[float, float, float]], by: list[str]) -> DataFrame:
    """(query_id, by..., s, field) of ``pairs`` (query_id, by..., fields...): the best rung over the fields, the earlier field where two are equal.

    Each pair is looked at once, in batches, where a query's tokens are split once.
    """
    known = tokens.select("query_id", F.lower("query").alias("__q"), F.array_join("tokens", " ").alias("__t"))
    lowered = [F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f"__{n}") for n, f in enumerate(fields)]
    wide = pairs.select("query_id", *by, *lowered).join(small(known, MOST_QUERIES), "query_id")
    kinds, names, steps = dict(wide.dtypes), list(fields), list(fields.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked: dict = {}
            scores, best = [], []
            columns = [batch.column(f"__{n}").to_pylist() for n in range(len(names))]
            qs, ts = batch.column("__q"), batch.column("__t")
            for row, query in enumerate(batch.column("query_id").to_pylist()):
                if query not in asked:
                    asked[query] = qs[row].as_py() or "", (ts[row].as_py() or "").split()
                found = [rung(texts[row], *asked[query], step) for texts, step in zip(columns, steps)]
                top = max(found)
                scores.append(top)
                best.append(names[found.index(top)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query_id", *by)), pa.array(scores, pa.float64()), pa.array(best, pa.string())], ["query_id", *by, "s", "field"])

    return wide.mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in ("query_id", *by)]) + ", s double, field string").filter("s > 0")


def _asked(tokens: DataFrame) -> DataFrame:
    return tokens.select("query_id", F.lower("query").alias("q"), "tokens", F.explode("tokens").alias("word"))


#: Queries whose tokens are broadcast at most.
MOST_QUERIES = 20_000
#: What the query itself, all of its tokens, and any token are worth in a node's fields, and in an edge's.
NODE_FIELDS = {"label": (1.0, 0.9, 0.6), "name": (0.95, 0.85, 0.55), "type": (0.5, 0.5, 0.5)}
EDGE_TYPE, EDGE_END = (0.65, 0.55, 0.45), (0.5, 0.4, 0.3)


#: Nodes and edges of a type that are found by its name alone: the first ones by label and id, or by their ends.
FIRST_OF_TYPE = 20


def _named_types(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, type) of types of whose words a query holds one."""
    spaced = F.replace("type", F.lit("_"), F.lit(" "))
    return rows.select("type").distinct().select("type", F.explode(F.array_distinct(_words(spaced))).alias("word")).join(asked, "word").select("query_id", "type").distinct()


def _first_of_type(rows: DataFrame, *order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("type").orderBy(*order))
    return rows.withColumn("__place", place).filter(F.col("__place") <= FIRST_OF_TYPE).drop("__place")


#: Queries and nodes that meet in one group.
QUERY_BLOCK, NODE_BLOCK = 1024, 8192


def _rounded(s: float) -> float:
    """``s`` in three digits as Spark's round has it."""
    return float(Decimal(repr(s)).quantize(Decimal("0.001"), ROUND_HALF_UP))


def _fitting(nodes: DataFrame, tokens: DataFrame, fields: dict[str, tuple[float, float, float]], top: int | None) -> DataFrame:
    """(query_id, id, label, score, field) of nodes whose label or name shares a word with a query; with ``top`` each block's best of a query alone.

    Blocks of queries meet blocks of nodes, so a pair that isn't among the best of its block leaves no task.
    """
    q, r = max(1, -(-tokens.count() // QUERY_BLOCK)), max(1, -(-nodes.count() // NODE_BLOCK))
    block = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asked = tokens.select("query_id", F.lower("query").alias("q"), "tokens", block("query_id", q).alias("qb"), every(r).alias("rb"))
    lowered = [F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f"__{n}") for n, f in enumerate(fields)]
    held = nodes.select("id", "label", *lowered, every(q).alias("qb"), block("id", r).alias("rb"))
    names, steps = list(fields), list(fields.values())
    worded = [n for n, f in enumerate(names) if f != "type"]
    kind = dict(tokens.dtypes)["query_id"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        queries = [(name, q or "", sorted(set(ts or ()), key=len, reverse=True)) for name, q, ts in zip(*(left.column(c).to_pylist() for c in ("query_id", "q", "tokens")))]
        holding: dict = {}
        for at, (_, _, ts) in enumerate(queries):
            for t in ts:
                holding.setdefault(t, []).append(at)
        words = re.compile("[a-z0-9_]{2,}").findall
        kept: list[list] = [[] for _ in queries]
        known: list[dict] = [{} for _ in names]
        rounds: dict = {}
        for id_, label, *texts in zip(*(right.column(c).to_pylist() for c in ("id", "label", *(f"__{n}" for n in range(len(names)))))):
            shared: dict = {}
            for n in worded:
                for word in set(words(texts[n])):
                    for at in holding.get(word, ()):
                        shared[at] = shared.get(at, 0) | 1 << n
            for at, fits in shared.items():
                _, q, ts = queries[at]
                s, field = -1.0, 0
                for n, low in enumerate(texts):
                    if fits >> n & 1 and low != q and q not in low and ts[0] not in low:
                        x = steps[n][2]  # a word is there and the longest isn't
                    elif n and (at, low) in known[n]:
                        x = known[n][at, low]
                    else:
                        x = rung(low, q, ts, steps[n])
                        if n and len(known[n]) < NODE_BLOCK:
                            known[n][at, low] = x
                    if x > s:
                        s, field = x, n
                if s > 0:
                    if s not in rounds:
                        rounds[s] = _rounded(s)
                    kept[at].append((-rounds[s], label is not None, label or "", id_, field))
                    if top is not None and len(kept[at]) >= 16 * top:
                        kept[at] = sorted(kept[at])[:top]
        rows = [(queries[at][0], id_, label if there else None, -s, names[field]) for at, own in enumerate(kept) for s, there, label, id_, field in (own if top is None else sorted(own)[:top])]
        kinds = [left.schema.field("query_id").type, pa.string(), pa.string(), pa.float64(), pa.string()]
        return pa.table({c: pa.array([row[i] for row in rows], k) for i, (c, k) in enumerate(zip(("query_id", "id", "label", "score", "field"), kinds))})

    return asked.groupBy("qb", "rb").cogroup(held.groupBy("qb", "rb")).applyInArrow(best, f"query_id {kind}, id string, label string, score double, field string")


def node_scores(nodes: DataFrame, tokens: DataFrame, top: int | None = None) -> DataFrame:
    """(query_id, id, label, score, field): the best rung over a node's label, name and type, the earlier field where two are equal.

    ``tokens`` are (query_id, query, tokens). Candidates share a word of their label or name with the query; a type that
    the query names adds only its first nodes, as it may be that of every node. With ``top`` those are left out of which
    that many others are better for their query by score, label and id, though not all of them.
    """
    fields = {f: steps for f, steps in NODE_FIELDS.items() if f in nodes.columns}
    found = _fitting(nodes, tokens, fields, top)
    if "type" in fields:
        asked = _asked(tokens).select("query_id", "word").distinct()
        first = _first_of_type(nodes.select("id", *fields), "label", "id").join(_named_types(nodes, asked), "type")
        named = _best_rungs(first.withColumn("__label", F.col("label")), tokens, fields, ["id", "__label"])
        found = found.unionByName(named.select("query_id", "id", F.col("__label").alias("label"), F.round("s", 3).alias("score"), "field")).distinct()
    return found


def edge_scores(nodes: DataFrame, edges: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, src, dst, type, score): the best rung over an edge's type and the labels of its ends.

    Words are listed for nodes and for types, not for edges: only edges at a node that shares a word with a query are
    looked at, and the first ones of a type that a query names.
    """
    asked = _asked(tokens).select("query_id", "word").distinct()
    ends = nodes.select("id", F.explode(F.array_distinct(_words(F.col("label")))).alias("word")).join(asked, "word").select("query_id", "id").distinct()
    fit = _best_rungs(ends.join(nodes.select("id", "label"), "id"), tokens, {"label": EDGE_END}, ["id"]).drop("field")
    at = lambda end: edges.join(fit.withColumnRenamed("id", end), end).select("query_id", "src", "dst", "type", "s")
    spaced = _named_types(edges, asked).withColumn("words", F.replace("type", F.lit("_"), F.lit(" ")))
    kinds = _best_rungs(spaced, tokens, {"words": EDGE_TYPE}, ["type"]).drop("field")
    # an edge found by an end has its type's score too
    found = at("src").unionByName(at("dst")).groupBy("query_id", "src", "dst", "type").agg(F.max("s").alias("s"))
    found = found.join(small(kinds.withColumnRenamed("s", "t"), MOST_QUERIES), ["query_id", "type"], "left").select("query_id", "src", "dst", "type", F.greatest("s", F.coalesce("t", F.lit(0.0))).alias("s"))
    by_type = _first_of_type(edges.select("src", "dst", "type"), "src", "dst").join(kinds, "type").select("query_id", "src", "dst", "type", "s")
    return found.unionByName(by_type).groupBy("query_id", "src", "dst", "type").agg(F.round(F.max("s"), 3).alias("score"))


def search(nodes: DataFrame, edges: DataFrame, tokens: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, rank, kind, id, dst, score): the best nodes by score, then label and id; edges fill what they leave of ``top``."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "label", "id")
    best = node_scores(nodes, tokens, top).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    best = cut(best.select("query_id", F.lit("node").alias("kind"), "id", F.lit("").alias("dst"), "score", F.col("place").cast("long").alias("rank")), "best-nodes")
    # edges come after all nodes, so only a query with room for them looks for any
    full = best.filter(F.col("rank") == top).select("query_id")
    roomy = cut(tokens.join(full, "query_id", "left_anti"), "queries-with-room")
    if roomy.isEmpty():
        return best.select("query_id", "rank", "kind", "id", "dst", "score")
    links = edge_scores(nodes, edges, roomy)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "src", "dst", "type")
    links = links.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    links = links.select("query_id", F.lit("relationship").alias("kind"), F.col("src").alias("id"), "dst", "score", (F.col("place") + top).cast("long").alias("rank"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    both = best.unionByName(links).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return both.select("query_id", "rank", "kind", "id", "dst", "score")


#: Facts told of all cited nodes, of one, and weak ones; and the rank from which on a fact is weak.
FACTS, OF_SUBJECT, WEAK, WEAK_RANK = 12, 3, 3, 9


def facts(cited: DataFrame, edges: DataFrame, ranks: dict[str, int], limit: int = FACTS, of_subject: int = OF_SUBJECT, weak: int = WEAK) -> DataFrame:
    """(query_id, n, src, type, dst): edges from cited nodes (query_id, place, id), told round by round: each node's strongest first, then each one's next.

    ``ranks`` give an edge type's rank, 5 by default, less being stronger; edges of one rank go by type and target.
    Each target is told once, each node at most so often, and of weak facts only a few. What can be told is among the
    first strong and the first weak edges of a node, as many as others may use up before and its own share: so
    many meet in a query's fold, with their places among all, and a hub's edges are never gathered.
    """
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col("type")), F.lit(5))
    told = cited.select("query_id", "place", F.col("id").alias("src")).join(edges.select("src", "dst", "type").distinct(), "src").withColumn("rank", rank)
    own = Window.partitionBy("query_id", "place", "src")
    order = ["rank", "type", "dst"]
    told = told.withColumn("depth", F.row_number().over(own.orderBy(*order))).withColumn("weak", F.col("rank") >= WEAK_RANK)
    among = F.row_number().over(Window.partitionBy("query_id", "place", "src", "weak").orderBy("depth"))
    told = told.withColumn("among", among).filter(F.col("among") <= limit + max(of_subject, weak))

    def fold(rows: pa.Table) -> pa.Table:
        used: set = set()
        count: dict = {}
        left, out = weak, []
        for r in rows.sort_by([("depth", "ascending"), ("place", "ascending"), ("src", "ascending")]).to_pylist():
            if len(out) == limit:
                break
            if r["dst"] in used or count.get(r["src"], 0) >= of_subject or (r["weak"] and not left):
                continue
            left -= r["weak"]
            used.add(r["dst"])
            count[r["src"]] = count.get(r["src"], 0) + 1
            out.append((r["query_id"], len(out) + 1, r["src"], r["type"], r["dst"]))
        names = ["query_id", "n", "src", "type", "dst"]
        kinds = [rows.schema.field("query_id").type, pa.int32(), pa.string(), pa.string(), pa.string()]
        return pa.table({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(zip(names, kinds))})

    return told.groupBy("query_id").applyInArrow(fold, f"query_id {dict(cited.dtypes)['query_id']}, n int, src string, type string, dst string")
