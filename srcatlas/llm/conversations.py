"""Repair of a conversation's structure by error-correcting Earley parsing.

Roles, by their first letters, have to form (s?(ua)+)?. The grammar below says so with left recursion only, and productions
for errors are added to its terminals: a row may be deleted or given another role, and a row may be inserted. A chart item
keeps the least (cost, audit); equal costs go to the audit that is least in ASCII. All items begin at the first row, so a
chart has a fixed number of items, and the parse is linear. Since the audit names what happens to each row, the completed
chart's audit is the repair.

Spark: faults are columns and one window over equal messages; the parse reads one letter a row, in the order of rows, never
texts. It holds a conversation's letters and audit (bytes a row); the result has that audit in one cell anyhow. Repaired rows
are a table, joined with their texts; digests read it in order, text by text, and hold none.

Rows: a null role or text is one space. Rows of a conversation are taken by turn, nulls first; rows of one turn by role, then
text, equal ones beside each other. Rows without a conv_id are one conversation. A role without letters adds nothing to the
roles' letters and may stay. Repeated conversations are one. Other columns are not read, whatever their names. Empty table:
empty result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, written

#: Left sides and right sides; "" is the whole, and "$" the end. H ends with a user's row, Q with an assistant's.
GRAMMAR = (("", ("$",)), ("", ("Q", "$")), ("Q", ("H", "a")), ("H", ("u",)), ("H", ("s", "u")), ("H", ("Q", "u")))
#: Roles that a row can be given, by their letters.
ROLES = {"u": "user", "a": "assistant"}


class Costs(NamedTuple):
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


BLANK, DUPLICATE, TRUNCATED = "b", "d", "t"
NO_SPACE = "[^ \\t\\n\\x0B\\f\\r]"


class Chart:
    """Earley sets over rows, one at a time; each item keeps its least (cost, audit)."""

    def __init__(self, costs: Costs = Costs(), grammar: tuple = GRAMMAR):
        self.costs, self.grammar = costs, grammar
        self.rules = defaultdict(list)
        for k, (left, _) in enumerate(grammar):
            self.rules[left].append(k)
        self.settled = ""  # what all audits begin with
        self.waiting = defaultdict(lambda: defaultdict(list))  # for each begin, the items before a nonterminal
        self.place = 0
        self.items = self._closed([((k, 0, 0), 0, "") for k in self.rules[""]], 0)

    def _next(self, item: tuple) -> str | None:
        right = self.grammar[item[0]][1]
        return right[item[1]] if item[1] < len(right) else None

    def _closed(self, seeds: list, here: int) -> dict:
        """All items of a set, least first: predictions, completions and insertions."""
        heap, items, whole = [(cost, audit, item) for item, cost, audit in seeds], {}, {}
        heapq.heapify(heap)
        while heap:
            cost, audit, item = heapq.heappop(heap)
            if item in items:
                continue
            items[item] = cost, audit
            rule, dot, begin = item
            symbol, left = self._next(item), self.grammar[rule][0]
            if symbol is None:
                if left and (begin, left) not in whole:
                    whole[begin, left] = cost, audit
                    for w, c, a in self.waiting.get(begin, {}).get(left, ()):
                        heapq.heappush(heap, (c + cost, a + audit, (w[0], w[1] + 1, w[2])))
            elif symbol in self.rules:
                self.waiting[here][symbol].append((item, cost, audit))
                for k in self.rules[symbol]:
                    heapq.heappush(heap, (0, "", (k, 0, here)))
                if (here, symbol) in whole:  # something empty
                    c, a = whole[here, symbol]
                    heapq.heappush(heap, (cost + c, audit + a, (rule, dot + 1, begin)))
            elif symbol in ROLES:
                heapq.heappush(heap, (cost + self.costs.insert, audit + "I", (rule, dot + 1, begin)))
        return items

    def add(self, letter: str, fault: str | None) -> None:
        """Read one row: the first letter of its role, and its fault."""
        seeds, gone = [], fault in (BLANK, DUPLICATE)
        stays = self.costs.truncated * (fault == TRUNCATED)
        for item, (cost, audit) in self.items.items():
            symbol = self._next(item)
            if symbol is None or symbol in self.rules:
                continue
            seeds.append((item, cost + self.costs.delete, audit + "D"))
            if gone:
                continue
            moved = (item[0], item[1] + 1, item[2])
            if not letter:
                seeds.append((item, cost + stays, audit + "K"))
            elif symbol == letter:
                seeds.append((moved, cost + stays, audit + "K"))
            if symbol in ROLES:
                seeds.append((moved, cost + self.costs.rerole + stays, audit + "R"))
        if all(item[2] == 0 for item, _, _ in seeds):  # what all share need not be carried along
            n = len(commonprefix([audit for _, _, audit in seeds]))
            self.settled += seeds[0][2][:n]
            seeds = [(item, cost, audit[n:]) for item, cost, audit in seeds]
        self.place += 1
        self.items = self._closed(seeds, self.place)

    def result(self) -> tuple[int, str]:
        """Cost and audit of the whole."""
        cost, audit = min(v for item, v in self.items.items() if self._next(item) == "$")
        return cost, self.settled + audit


def repaired(letters: list[str], audit: str) -> list[tuple[int | None, str | None]]:
    """Which rows a repair has, and the role that each is given: (place or None if inserted, role or None if kept)."""
    out, at, last = [], 0, "a"
    for edit in audit:
        if edit == "K":
            out.append((at, None))
            last = {"s": "a"}.get(letters[at], letters[at]) or last
        elif edit in "RI":
            last = "u" if last == "a" else "a"
            out.append((at if edit == "R" else None, ROLES[last]))
        at += edit != "I"
    return out


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (no nulls in the last two), copy: with the first letter of the role and the fault of each."""
    seen = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    last = F.regexp_extract("text", f"({NO_SPACE})[ \\t\\n\\x0B\\f\\r]*\\z", 1)
    blank = ~F.col("text").rlike(NO_SPACE)
    fault = F.when(blank, BLANK).when(F.row_number().over(seen) > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED)
    return rows.select("*", F.substring("role", 1, 1).alias("letter"), fault.alias("fault"))


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def parsed(costs: Costs):
    """For rows of conversations in order: a row of figures for each, and one for each repaired row (place is not null)."""
    names = ["conv_id", "place", "id", "given", *(c.split()[0] for c in SUMMARY.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        columns = {n: [] for n in names}

        def put(**values) -> None:
            for n in names:
                columns[n].append(values.get(n))

        def out() -> pa.RecordBatch:
            nonlocal columns
            done, columns = columns, {n: [] for n in names}
            return pa.RecordBatch.from_arrays([pa.array(done[n], t) for n, t in zip(names, types, strict=True)], names=names)

        def close() -> None:
            cost, audit = chart.result()
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            near = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
            put(conv_id=conv, gaps=gaps, blank=faults[BLANK], duplicate=faults[DUPLICATE], truncated=faults[TRUNCATED], illegal=near, cost=cost, audit=audit)
            for place, (at, role) in enumerate(repaired(letters, audit)):
                put(conv_id=conv, place=place, id=None if at is None else ids[at], given=role)

        some, conv = False, None
        for batch in batches:
            types = types or [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6, pa.string()]
            for own, turn, letter, fault, i in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "letter", "fault", "id")), strict=True):
                if not some or own != conv:
                    if some:
                        close()
                    some, conv, chart, letters, ids, turns, faults = True, own, Chart(costs), [], [], set(), defaultdict(int)
                chart.add(letter, fault)
                letters.append(letter)
                ids.append(i)
                faults[fault] += 1
                if turn is not None:
                    turns.add(turn)
            if len(columns["place"]) > 10_000:
                yield out()
        if some:
            close()
            yield out()

    return run


def repair(rows: DataFrame, costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """rows: conv_id, turn, role, text, copy. Returns the repaired rows (conv_id, place, role, text) and a row of figures
    for each conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)."""
    prepare(rows.sparkSession)
    found = written(with_faults(rows).withColumn("id", F.monotonically_increasing_id()), "messages")
    conv_type = found.schema["conv_id"].dataType.simpleString()
    # Only rows that share a turn and a role need their texts for the order.
    ties = found.groupBy("conv_id", "turn", "role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("texts")).filter("texts > 1")
    same = [found[c].eqNullSafe(ties[c]) for c in ("conv_id", "turn", "role")]
    tied = found.join(ties, same[0] & same[1] & same[2], "left_semi").select("id", F.dense_rank().over(Window.partitionBy("conv_id", "turn", "role").orderBy("text")).alias("rank"))
    narrow = found.select("conv_id", "turn", "role", "copy", "letter", "fault", "id").join(tied, "id", "left")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "rank", "copy", "id"]
    dealt = narrow.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "letter", "fault", "id")
    both = written(dealt.mapInArrow(parsed(costs), f"conv_id {conv_type}, place long, id long, given string, {SUMMARY}"), "repairs")
    rows_ = both.filter("place is not null").select("conv_id", "place", "id", "given")
    text = found.select("id", "role", "text")
    joined = rows_.join(text, "id", "left").select("conv_id", "place", F.coalesce("given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return joined, both.filter("place is null").drop("place", "id", "given")


def digests(repaired_rows: DataFrame) -> DataFrame:
    """conv_id and the sha256 of its rows' role:text, joined by newlines."""
    conv_type = repaired_rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        conv, state, found, kind = None, None, [], None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for own, line in zip(batch.column("conv_id").to_pylist(), batch.column("line"), strict=True):
                if state is None or own != conv:
                    if state is not None:
                        found.append((conv, state.hexdigest()))
                    conv, state = own, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([x for _, x in found], pa.string())], names=["conv_id", "sha256"])
            found = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "sha256"])

    lines = repaired_rows.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line").mapInArrow(run, f"conv_id {conv_type}, sha256 string")


def clean(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy of a table of conversations: null roles and texts are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(0).alias("copy"))


def damaged(conversations: DataFrame) -> DataFrame:
    """clean() with planted faults, by crc32 of conv_id:turn modulo 20: 0 drops a row, 1 empties its text, 2 removes
    . ! ? from it, 3 repeats it in its turn, 4 gives it the role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = clean(conversations).withColumn("kind", kind).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"))


def repaired_conversations(conversations: DataFrame, rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Every conv_id of conversations with the figures of its rows' repair and the digest of the result."""
    lines, figures = repair(rows, costs)
    every = conversations.select("conv_id").distinct()
    sums = digests(lines).withColumnRenamed("conv_id", "c")
    found = figures.join(sums, figures.conv_id.eqNullSafe(sums.c), "left").drop("c").withColumnRenamed("conv_id", "c")
    out = every.join(found, every.conv_id.eqNullSafe(F.col("c")), "left").drop("c")
    none = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.withColumns(none | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("sha256", F.sha2(F.lit(""), 256))}).drop("sha256")
