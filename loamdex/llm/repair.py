"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, by grammar-compressed dynamic programming.

A conversation is a sequence of symbols: each row's role initial, whether it is truncated, or that it must go. Re-Pair
finds pairs of symbols that are frequent over all conversations and gives each a rule. A symbol is a min-plus matrix
over the four states of the wanted form ``(s?(ua)+)?``: what the cheapest edits of the rows it stands for cost from one
state to another, with a rope of their initials. Matrices of rules are products, made bottom-up once and shared by all
conversations, whose own matrices are products of few symbols.

Strings that lead from one state to two others hold one letter for each row and end with a row's letter, so none of
them begins another, and which is smaller follows from the first part in which they differ: a matrix keeps the order of
each state's strings, and ropes are never compared.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.session import cut

#: Rows of a segment, and bytes from which on a segment ends. A longer conversation is several segments.
SEGMENT, SEGMENT_BYTES = 1024, 1 << 22
#: Rules of a grammar at most, and how often pairs are counted to find them. They bear on speed alone.
RULES, COUNTS = 256, 10
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: What may be inserted in each state, and what closes a conversation that ends there.
INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LEGAL = {"su", "ua", "au"}
#: The symbol of rows that must go; others are a role's initial, upper case if truncated, and o for other roles.
GONE = "x"
LETTERS = "suaoSUAO" + GONE
BLANKS = " \t\n\x0b\x0c\r"

Rope = str | tuple


class Matrix:
    """Costs, ropes and the order of strings by (state before, state after); a pair that no edits join is absent."""

    __slots__ = ("cost", "rope", "rank")

    def __init__(self, cost: dict, rope: dict, rank: dict):
        self.cost, self.rope, self.rank = cost, rope, rank


def leaf(symbol: str) -> Matrix:
    """One row: insertions before it, then its own edit."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    initial, late = symbol.lower(), TRUNCATED * symbol.isupper()
    for p in STATES:
        at, cost, done = p, 0, ""
        for _ in range(3):  # a third insertion leads back to where the first did
            ways = [(at, DELETE, "D")]
            if symbol != GONE:
                ways.append((INSERTED[at], REROLE + late, "R"))
                if (initial, at) in KEPT:
                    ways.append((KEPT[initial, at], late, "K"))
            for q, price, letter in ways:
                best[p, q] = min(best.get((p, q), (cost + price, done + letter)), (cost + price, done + letter))
            at, cost, done = INSERTED[at], cost + INSERT, done + "I"
    order = {p: sorted((text, q) for (o, q), (_, text) in best.items() if o == p) for p in STATES}
    rank = {(p, q): n for p in STATES for n, (_, q) in enumerate(order[p])}
    return Matrix({k: v[0] for k, v in best.items()}, {k: v[1] for k, v in best.items()}, rank)


def product(a: Matrix, b: Matrix) -> Matrix:
    """Edits of one stretch, then of the next: cheapest first, then the smaller string."""
    cost, rope, rank = {}, {}, {}
    for p in STATES:
        via = {}
        for q in STATES:
            ways = [(a.cost[p, r] + b.cost[r, q], a.rank[p, r], r) for r in STATES if (p, r) in a.cost and (r, q) in b.cost]
            if ways:
                price, _, r = min(ways)
                cost[p, q], rope[p, q], via[q] = price, (a.rope[p, r], b.rope[r, q]), r
        for n, q in enumerate(sorted(via, key=lambda q: (a.rank[p, via[q]], b.rank[via[q], q]))):
            rank[p, q] = n
    return Matrix(cost, rope, rank)


def flat(rope: Rope) -> str:
    """A rope's text."""
    out, left = [], [rope]
    while left:
        x = left.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            left += [x[1], x[0]]
    return "".join(out)


class Grammar:
    """Re-Pair rules in order: each names a pair of earlier symbols, and has a symbol and a matrix of its own."""

    def __init__(self, pairs: list[str]):
        self.pairs = pairs
        self.symbols = [chr(0x100 + n) for n in range(len(pairs))]
        self.matrices = {c: leaf(c) for c in LETTERS}
        for pair, symbol in zip(pairs, self.symbols):
            self.matrices[symbol] = product(self.matrices[pair[0]], self.matrices[pair[1]])
        self.solve = lru_cache(1 << 14)(self._solve)
        self.matrix = lru_cache(1 << 8)(self._matrix)

    def __reduce__(self):
        return Grammar, (self.pairs,)

    def compress(self, text: str) -> str:
        for pair, symbol in zip(self.pairs, self.symbols):
            text = text.replace(pair, symbol)
        return text

    def _matrix(self, text: str) -> Matrix:
        """The matrix of a whole segment, which isn't empty."""
        short = self.compress(text)
        made = self.matrices[short[0]]
        for symbol in short[1:]:
            made = product(made, self.matrices[symbol])
        return made

    def _solve(self, text: str) -> tuple[int, str]:
        """(cost, initials) of the cheapest edits of a whole conversation."""
        if not text:
            return 0, ""
        made = self.matrix(text)
        price, _, q = min((made.cost[START, q] + INSERT * len(CLOSING[q]), made.rank[START, q], q) for q in STATES if (START, q) in made.cost)
        return price, flat(made.rope[START, q]) + CLOSING[q]


def learn(sequences: DataFrame) -> Grammar:
    """A grammar of the pairs that are most frequent over all ``symbols``, found in a few counts over the different sequences.

    Each count picks the most frequent pairs that share no symbol, so that the order in which they are replaced
    doesn't matter; pairs of one symbol don't overlap. Sums by pair are shuffled, of which there are at most as many as
    pairs of symbols.
    """
    counted = cut(sequences.groupBy("symbols").count(), "role-sequences")
    pairs: list[str] = []
    for _ in range(COUNTS):
        grammar = Grammar(pairs)

        def run(batches: Iterable[pa.RecordBatch], own: Grammar = grammar) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in batches:
                for text, n in zip(batch.column("symbols").to_pylist(), batch.column("count").to_pylist()):
                    last = ""
                    for pair in map("".join, zip((short := own.compress(text)), short[1:])):
                        last = "" if pair == last and pair[0] == pair[1] else pair
                        seen[pair] += n if last else 0
            yield pa.RecordBatch.from_pydict({"pair": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

        sums = counted.mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        used: set[str] = set()
        for r in sums.filter("n > 1").orderBy(F.desc("n"), "pair").limit(RULES).collect():  # RULES rows
            if len(pairs) < RULES and not used & set(r.pair):
                used |= set(r.pair)
                pairs.append(r.pair)
        if not used:
            break
    return Grammar(pairs)


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20; a null counts as one space.

    0 drops a row, which then is marked ``gone``, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it a user's.
    """
    space = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce(F.col("text").cast("string"), space), F.coalesce(F.col("role").cast("string"), space)
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_STATS = ", ".join(f"{c} long" for c in _COUNTS) + ", first_turn long, last_turn long"


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, seg, whole, counts..., first_turn, last_turn, symbols, roles, texts): each conversation's rows in order, as symbols.

    Rows are shuffled and sorted by conversation, and folded as they stream by. ``roles`` and ``texts`` are those of
    rows that may stay. ``whole`` marks a conversation of one segment. What is held of a conversation meanwhile is a
    segment, and a digest of 16 bytes for each different row.
    """
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    kind = dict(rows.dtypes)["conv_id"]
    blank = F.lit(" ")
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"), gone.alias("gone"))
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        now, seen, row, size = object(), set(), None, 0
        before = turn_before = None

        def fresh(conv: object, seg: int) -> dict:
            return {"conv_id": conv, "seg": seg, "whole": seg == 0, **dict.fromkeys(_COUNTS, 0), "first_turn": None, "last_turn": None, "symbols": [], "roles": [], "texts": []}

        def closed(r: dict) -> dict:
            return r | {"symbols": "".join(r["symbols"])}

        for batch in batches:
            for conv, turn, role, text, lost in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone"))):
                if row is None or conv != now:
                    if row is not None:
                        yield closed(row)
                    now, seen, row, size, before, turn_before = conv, set(), fresh(conv, 0), 0, None, None
                if lost:
                    continue
                if len(row["symbols"]) >= SEGMENT or size >= SEGMENT_BYTES:
                    row["whole"] = False
                    yield closed(row)
                    row, size = fresh(conv, row["seg"] + 1), 0
                size += len(text)
                if turn is not None:
                    row["first_turn"] = turn if row["first_turn"] is None else row["first_turn"]
                    row["last_turn"] = turn
                    row["turns"] += turn != turn_before
                    turn_before = turn
                row["illegal"] += before is not None and before + role[:1] not in LEGAL
                before = role[:1]
                digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                said = text.rstrip(BLANKS)
                if not said or digest in seen:
                    row["duplicate" if said else "blank"] += 1
                    row["symbols"].append(GONE)
                else:
                    seen.add(digest)
                    late = said[-1] not in ".!?"
                    row["truncated"] += late
                    symbol = role[:1] if role[:1] in ("s", "u", "a") else "o"
                    row["symbols"].append(symbol.upper() if late else symbol)
                    row["roles"].append(role)
                    row["texts"].append(text)
        if row is not None:
            yield closed(row)

    schema = f"conv_id {kind}, seg int, whole boolean, {_STATS}, symbols string, roles array<string>, texts array<string>"
    return ordered.mapInArrow(_batched(fold, schema, rows), schema)


def _batched(make, schema: str, like: DataFrame):
    """A function for ``mapInArrow`` from one that yields rows as dicts, which are sent in batches of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(like.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in make(batches):
            held.append(row)
            size += 200 + sum(map(len, row.get("texts") or ()))
            if size >= 1 << 22:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return run


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for at in range(0, batch.num_rows, 256):
        yield from batch.slice(at, 256).to_pylist()


def edited(audit: str, row: dict, state: int) -> tuple[list[str], list[str]]:
    """(roles, texts) of a segment after its edits."""
    roles, texts, i, k = [], [], 0, 0
    for letter in audit:
        role, text = "assistant" if state == USER else "user", ""
        if letter != "I":
            stays = row["symbols"][i] != GONE
            i, k = i + 1, k + stays
            if letter == "D":
                continue
            text = row["texts"][k - 1]
            role = row["roles"][k - 1] if letter == "K" else role
        roles.append(role)
        texts.append(text)
        state = KEPT[role[:1], state]
    return roles, texts


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, seg, whole, counts, cost, audit, roles, texts): the repaired conversations of ``rows`` (conv_id, turn, role, text, whatever else).

    Rows come by turn, nulls first, then by role and text; repeated rows are more rows. A null role or text is one
    space, which is a role of no form and a blank text. Null conv_ids are one conversation. A row is blank, else a
    duplicate of an earlier row of its conversation, else truncated: it doesn't end with one of ``.!?``. Edits: keep,
    rerole to user or assistant at 2, delete at 3 (blank and duplicate rows must go), insert an empty user or assistant
    at 2; truncated rows that stay add 1. ``audit`` holds the initials of the cheapest edits, the least in ASCII of
    equal ones, ``roles`` and ``texts`` what is left. A column ``gone``, if there is one, marks rows that only
    witness their conversation. An empty table gives no row.

    A conversation of more than 1,024 rows, or of 4 MB, is several rows in order of ``seg``; its costs and counts are to
    be summed, its audits and lists joined. No conversation is ever one group in memory: only its segments' small
    matrices are folded in order.
    """
    found = cut(segments(rows), "segments")
    grammar = learn(found.select("symbols"))
    shared = rows.sparkSession.sparkContext.broadcast(grammar)  # RULES pairs
    schema = f"{_head(found)}, cost long, audit string, roles array<string>, texts array<string>"

    def small(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for r in _rows(batch):
                cost, audit = shared.value.solve(r["symbols"])
                roles, texts = edited(audit, r, START)
                yield r | {"cost": cost, "audit": audit, "roles": roles, "texts": texts}

    whole = found.filter("whole").mapInArrow(_batched(_chosen(small, schema), schema, rows), schema)
    rest = found.filter("not whole")
    if rest.isEmpty():
        return whole

    def large(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for r in _rows(batch):
                audit = r["closing"]
                if r["symbols"]:
                    audit = flat(shared.value.matrix(r["symbols"]).rope[r["p"], r["q"]]) + audit
                roles, texts = edited(audit, r, r["p"])
                yield r | {"audit": audit, "roles": roles, "texts": texts}

    ways = _ways(rest, shared).select(F.col("conv_id").alias("__conv"), F.col("seg").alias("__seg"), "p", "q", "cost", "closing")
    joined = rest.join(ways, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("seg") == F.col("__seg"))).drop("__conv", "__seg")
    return whole.unionByName(joined.mapInArrow(_batched(_chosen(large, schema), schema, rows), schema))


def _head(found: DataFrame) -> str:
    return f"conv_id {dict(found.dtypes)['conv_id']}, seg int, whole boolean, {_STATS}"


def _chosen(make, schema: str):
    names = [part.split()[0] for part in schema.split(", ")]
    return lambda batches: ({c: r[c] for c in names} for r in make(batches))


def _ways(rest: DataFrame, shared) -> DataFrame:
    """(conv_id, seg, p, q, cost, closing): the states between which each segment of a long conversation is edited, and what that costs.

    Segments are reduced to their matrices where they lie; of those, costs and orders are sorted by conversation and folded.
    """

    def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for r in _rows(batch):
                m = shared.value.matrix(r["symbols"])
                cells = [(p, q) for p in STATES for q in STATES]
                yield {"conv_id": r["conv_id"], "seg": r["seg"], "costs": [m.cost.get(c, -1) for c in cells], "ranks": [m.rank.get(c, -1) for c in cells]}

    kind = dict(rest.dtypes)["conv_id"]
    schema = f"conv_id {kind}, seg int, costs array<long>, ranks array<int>"
    made = rest.select("conv_id", "seg", "symbols").mapInArrow(_batched(matrices, schema, rest), schema)
    ordered = made.repartition("conv_id").sortWithinPartitions("conv_id", "seg")

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        now, started = None, False
        best: dict[int, tuple[int, int]] = {}
        steps: list[tuple[bytes, list[int]]] = []

        def closed() -> Iterator[dict]:
            q = min((cost + INSERT * len(CLOSING[q]), rank, q) for q, (cost, rank) in best.items())[2]
            path, at = [], q
            for via, costs in reversed(steps):
                path.append((via[at], at, costs[4 * via[at] + at]))
                at = via[at]
            for n, (p, to, cost) in enumerate(reversed(path)):
                end = CLOSING[q] if n == len(path) - 1 else ""
                yield {"conv_id": now, "seg": n, "p": p, "q": to, "cost": cost + INSERT * len(end), "closing": end}

        for batch in batches:
            for r in _rows(batch):
                if not started or r["conv_id"] != now:
                    if started:
                        yield from closed()
                    now, started, best, steps = r["conv_id"], True, {START: (0, 0)}, []
                costs, ranks, via, after = r["costs"], r["ranks"], bytearray(4), {}
                for q in STATES:
                    ways = [(cost + costs[4 * p + q], rank, p) for p, (cost, rank) in best.items() if costs[4 * p + q] >= 0]
                    if ways:
                        price, rank, via[q] = min(ways)
                        after[q] = (price, (rank, ranks[4 * via[q] + q]))
                order = sorted(after, key=lambda q: after[q][1])
                best = {q: (after[q][0], n) for n, q in enumerate(order)}
                steps.append((bytes(via), costs))
        if started:
            yield from closed()

    schema = f"conv_id {kind}, seg int, p int, q int, cost long, closing string"
    return ordered.mapInArrow(_batched(fold, schema, rest), schema)


def turns(repaired: DataFrame) -> DataFrame:
    """(conv_id, seg, place, role, text): one row for each turn of repaired conversations."""
    return repaired.select("conv_id", "seg", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "t")).select("conv_id", "seg", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def _gaps() -> Column:
    return F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")


def report(repaired: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    A whole conversation's digest is an expression; those of several segments are sorted and hashed as they stream by.
    """
    counts = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    whole = repaired.filter("whole").select("conv_id", _gaps(), *counts, F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256"))
    rest = repaired.filter("not whole")
    kind = dict(repaired.dtypes)["conv_id"]

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        row, digest, audit, first, parted = None, None, [], None, False

        def closed() -> dict:
            gaps = 0 if first is None else row["last_turn"] - first + 1 - row["turns"]
            return {c: row[c] for c in ("conv_id", *counts[:-1])} | {"gaps": gaps, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

        for batch in batches:
            for r in _rows(batch):
                if row is None or r["conv_id"] != row["conv_id"]:
                    if row is not None:
                        yield closed()
                    row, digest, audit, first, parted = r, hashlib.sha256(), [], r["first_turn"], False
                else:
                    first = r["first_turn"] if first is None else first
                    last = row["last_turn"] if r["last_turn"] is None else r["last_turn"]
                    row = r | {c: row[c] + r[c] for c in (*_COUNTS, "cost")} | {"last_turn": last}
                audit.append(r["audit"])
                for role, text in zip(r["roles"], r["texts"]):
                    digest.update(f"{chr(10) if parted else ''}{role}:{text}".encode())
                    parted = True
        if row is not None:
            yield closed()

    schema = f"conv_id {kind}, gaps long, {', '.join(f'{c} long' for c in counts[:-1])}, audit string, repaired_sha256 string"
    ordered = rest.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return whole.unionByName(ordered.mapInArrow(_batched(fold, schema, repaired), schema))
