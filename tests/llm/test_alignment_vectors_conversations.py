"""Alignment, vector near-duplicates and conversation repair against brute force, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from srcatlas.llm import alignment, conversations, vector_dedup

SF = "/root/testdata/sf0.001"


# ---- 12 alignment ----


def plain_tokens(text: str | None):
    """Ids and bytes of both sides, or None where they do not give the text again."""
    a, b = (s.encoder for s in alignment.sides(alignment.default_path(), alignment.default_pieces()))
    want = (" " + (text or "")).encode()
    left = [(i, a.names_[i]) for i in a.tokenizer.encode(" " + text, add_special_tokens=False).ids] if text else []
    right = [(i, b.names_[i]) for i in b.model.encode(text)] if text else []
    return (left, right) if text and all(b"".join(x for _, x in s) == want for s in (left, right)) else None


def plain_alignment(rows: list[tuple]) -> list[tuple]:
    for s in alignment.sides(alignment.default_path(), alignment.default_pieces()):
        s.encoder.names_ = s.encoder.token_bytes()
    counts, docs = Counter(), []
    for doc_id, text in rows:
        links, groups, ga, gb = [], [], [], []
        found = plain_tokens(text) or ([], [])
        (a, b), i, j = found, 0, 0
        end_a = np.cumsum([len(x) for _, x in a])
        end_b = np.cumsum([len(x) for _, x in b])
        while i < len(a):
            links.append((a[i][0], b[j][0]))
            x, y = end_a[i], end_b[j]
            if x <= y:
                ga.append(str(a[i][0]))
                i += 1
            if y <= x:
                gb.append(str(b[j][0]))
                j += 1
            if x == y:
                groups.append(",".join(ga) + "|" + ",".join(gb))
                ga, gb = [], []
        counts.update(links)
        docs.append((doc_id, len(a), len(b), links, groups))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(d, na, nb, len(g), len(x), ";".join(g), sum(counts[k] == best[k[1]] for k in x), sum(counts[k] for k in x)) for d, na, nb, x, g in docs]


ODD = [
    (None, None), (-(2**63), ""), (9001, "  a  b "), (9002, "<|endoftext|> x <s> é😀\0q"), (9003, "a▁b"), (9004, " "), (9005, "\n\n x\t\ty  　z"), (9005, "\n\n x\t\ty  　z"),
    (9006, "x" * 5000), (9007, "never " * 30_000), (9008, "▁"), (9009, "don't stop."),
]
ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")


def test_alignment_equals_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(150)
    more = spark.createDataFrame([(*r, "x", 7) for r in ODD], "doc_id long, text string, Groups string, Batch int")
    both = docs.selectExpr("*", "'x' AS Groups", "7 AS Batch").union(more).repartition(4)
    monkeypatch.setattr(alignment, "PART_BYTES", 4000)  # so that stripes are divided
    want = sorted(plain_alignment([(r.doc_id, r.text) for r in both.select("doc_id", "text").collect()]), key=str)
    assert sorted((tuple(r[c] for c in ALIGNED) for r in alignment.align(both).collect()), key=str) == want
    shown = {(r.doc_id, r.groups_sha256) for r in alignment.align(both, digests=True).select("doc_id", "groups_sha256").collect()}
    assert shown == {(w[0], hashlib.sha256(w[5].encode()).hexdigest() if w[5] else "") for w in want}


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), digests=True).collect() == []


def test_blocks_come_back():
    rng = np.random.default_rng(0)
    x = [np.sort(rng.integers(0, 2**32, 1000)).astype(np.uint32), rng.integers(0, 9, 7), np.zeros(0, np.int32), rng.integers(-(2**60), 2**60, 50)]
    for a, b in zip(x, alignment.unpacked(alignment.packed(*x), 4), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_sums_of_many_cells(monkeypatch):
    monkeypatch.setattr(alignment, "MOST_CELLS", 50)
    rng, want, batches = np.random.default_rng(1), Counter(), []
    for _ in range(30):
        cells = np.unique(rng.integers(0, 500, 20)).astype(np.uint32)
        want.update({int(c): 1 for c in cells})
        batches.append(pa.RecordBatch.from_arrays([pa.array([3]), pa.array([alignment.packed(cells, np.ones(len(cells), np.uint32), np.zeros(len(cells), np.int32), np.ones(len(cells), np.uint32))])], names=["stripe", "links"]))
    got = Counter()
    for b in alignment.summed(iter(batches)):
        for block in b.column("cells").to_pylist():
            cells, n = alignment.unpacked(block, 2)
            got.update(dict(zip(cells.tolist(), n.tolist(), strict=True)))
    assert got == want


# ---- 13 vectors ----


def plain_vectors(rows: list, least: float) -> list[tuple]:
    good = lambda r: r.embedding and r.label is not None and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)
    groups, n, root = defaultdict(list), [0] * len(rows), list(range(len(rows)))
    for k, r in enumerate(rows):
        if good(r):
            groups[r.label, len(r.embedding)].append(k)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for ks in groups.values():
        x = np.array([rows[k].embedding for k in ks], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            n[ks[i]] += 1
            n[ks[j]] += 1
            root[top(ks[i])] = top(ks[j])
    low = {}
    for k, r in enumerate(rows):
        if r.vec_id is not None:
            low[top(k)] = min(low.get(top(k), 2**63), r.vec_id)
    return sorted(((r.vec_id, n[k], low.get(top(k)), r.vec_id == low.get(top(k))) for k, r in enumerate(rows)), key=str)


def near(rng, base: np.ndarray, n: int, noise: float) -> list[list[float]]:
    return [(base + noise * rng.normal(size=len(base)) / np.sqrt(len(base))).tolist() for _ in range(n)]


VECTORS = "vec_id long, embedding array<float>, label int, U int, N_links string"


def vector_rows() -> list[tuple]:
    """Crowds of near copies about the threshold, scattered vectors, and every odd one."""
    rng = np.random.default_rng(3)
    unit = lambda d: (lambda v: v / np.linalg.norm(v))(rng.normal(size=d))
    some = [v for k in range(12) for v in near(rng, unit(24), int(rng.integers(2, 12)), 0.1 + 0.01 * k)] + near(rng, unit(24), 150, 0.14) + [unit(24).tolist() for _ in range(200)]
    rows = [(int(i), v, int(i) % 3 if i % 7 else 0) for i, v in zip(rng.permutation(len(some)), some, strict=True)]
    nan, inf, base = float("nan"), float("inf"), [0.5] * 24
    rows += [(None, base, 1), (5001, base, 1), (5001, base, 1), (5002, [-x for x in base], 1), (5003, None, 1), (5004, [0.0] * 24, 1), (5005, [nan] * 24, 1), (5006, [None, *base[1:]], 1)]
    rows += [(5007, base, None), (5008, [1.0, 2.0], 1), (5009, [2.0, 4.0], 1), (5010, [inf] * 24, 2), (5011, [], 2), (-(2**63), [1.0, 2.0], 1), (None, [3.0, 1.0], 1), (None, [3.0, 1.0], 1)]
    return [(*r, 1, "x") for r in rows]


@pytest.mark.parametrize("tile", [512, 16])
def test_vectors_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    monkeypatch.setattr(vector_dedup, "PART", 4 * tile)
    df = spark.createDataFrame(vector_rows(), VECTORS).repartition(4)
    want = plain_vectors(df.collect(), 0.98)
    got = sorted((tuple(r) for r in vector_dedup.near_vectors(df).collect()), key=str)
    assert got == want and sum(x[1] for x in want) > 1000


def test_vectors_of_the_table_have_full_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert sorted((tuple(r) for r in vector_dedup.near_vectors(df, lists=32).collect()), key=str) == plain_vectors(df.collect(), 0.98)


def test_vectors_without_any_good_one(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    bad = spark.createDataFrame([(1, None, 1, 1, ""), (None, [0.0], 1, 1, ""), (2, [1.0], None, 1, "")], VECTORS)
    assert sorted((tuple(r) for r in vector_dedup.near_vectors(bad).collect()), key=str) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]


def test_every_link_meets_in_a_list():
    """The bound on probes: of two near units in different lists one visits the other's, whatever the centroids."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    x[1500:] = x[:1500] + 0.04 * rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = vector_dedup.fit(x[rng.choice(3000, 400, replace=False)], 40)
    home, code, error, far = vector_dedup.encode(x, index, np.sqrt(0.04) / 2)
    linked = [(i, i + 1500) for i in range(1500) if x[i] @ x[i + 1500] >= 0.98]
    assert sum(home[i] != home[j] for i, j in linked) > 20
    assert all(home[i] == home[j] or home[j] in far[i] or home[i] in far[j] for i, j in linked)
    assert sum(map(len, far)) < 3000 * 20


# ---- 11 conversations ----


def plain_repair(rows: list[tuple[str, str | None]]) -> tuple[int, str]:
    """Least (cost, audit) over (place, state): 0 nothing, 1 after s, 2 after u, 3 after a."""
    best, heap = {}, [(0, "", 0, 0)]
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in best:
            continue
        best[i, state] = cost, audit
        steps = {x: {"s": 1, "u": 2, "a": 3}[x] for x in ("su", "u", "a", "u")[state]}
        for x, to in steps.items():
            if x != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", i, to))
        if i < len(rows):
            letter, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            more = cost + (fault == "t")
            if fault not in ("b", "d"):
                if not letter:
                    heapq.heappush(heap, (more, audit + "K", i + 1, state))
                for x, to in steps.items():
                    if x == letter:
                        heapq.heappush(heap, (more, audit + "K", i + 1, to))
                    if x != "s":
                        heapq.heappush(heap, (more + 2, audit + "R", i + 1, to))
    return min(best[len(rows), s] for s in (0, 3))


def test_the_parser_finds_the_cheapest_repair():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(rng.choice("uuaas") if rng.random() < 0.9 else rng.choice(["", "t"]), rng.choice([None, None, None, "b", "d", "t"])) for _ in range(rng.randint(0, 12))]
        chart = conversations.Chart()
        for r in rows:
            chart.add(*r)
        assert chart.result() == plain_repair(rows)
        letters = [x for x, _ in rows]
        left = "".join((role or letters[at])[:1] for at, role in conversations.repaired(letters, chart.result()[1]))
        assert re.fullmatch("(s?(ua)+)?", left)


def test_a_chart_stays_small():
    rng, chart = random.Random(2), conversations.Chart()
    for _ in range(20_000):
        chart.add(rng.choice("uuaas"), rng.choice([None, None, "t"]))
    cost, audit = chart.result()
    assert len(chart.items) < 20 and len(audit) >= 20_000 and cost > 0


def plain_conversations(rows: list) -> list[tuple]:
    show = lambda x: " " if x is None else str(x)
    groups = defaultdict(list)
    for r in rows:
        own, kind, role, text = groups[r.conv_id], zlib.crc32(f"{show(r.conv_id)}:{show(r.turn)}".encode()) % 20, show(r.role), show(r.text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(r.turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            last = re.findall("[^ \t\n\x0b\f\r]", text)[-1:]
            faults.append("b" if not last else "d" if (role, text) in seen else None if last[0] in ".!?" else "t")
            seen.add((role, text))
        turns, letters = {t for t, _, _ in own if t is not None}, [r[:1] for _, r, _ in own]
        cost, audit = plain_repair(list(zip(letters, faults, strict=True)))
        lines, i, last = [], 0, "a"
        for edit in audit:
            if edit == "K":
                lines.append(f"{own[i][1]}:{own[i][2]}")
                last = {"s": "a", "": last}.get(letters[i], letters[i])
            elif edit in "RI":
                last = "u" if last == "a" else "a"
                lines.append({"u": "user:", "a": "assistant:"}[last] + (own[i][2] if edit == "R" else ""))
            i += edit != "I"
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
        out.append((conv, gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


REPAIRED = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repairs_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(None, 1, "user", "Hi."), (None, None, None, None), (None, 2, "assistant", "Yes"), (90001, 1, "user", ""), (90002, 5, "system", "A."), (90002, 5, "system", "A."), (90002, 7, "user", "B.\n")]
    rows += [(90003, None, "", "."), (90005, 4, "user", "End. "), (90006, 2, "assistant", "x " * 50_000)]
    rows += [(90004, rng.randint(0, 200), rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "B", "C!", "", " \n"])) for _ in range(300)]
    kind = "conv_id long, turn long, role string, text string"
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").union(spark.createDataFrame(rows, kind)).selectExpr("*", "1 AS Copy", "2 AS id", "'x' AS AUDIT").repartition(4)
    got = conversations.repaired_conversations(table, conversations.damaged(table))
    assert sorted((tuple(r[c] for c in REPAIRED) for r in got.collect()), key=str) == plain_conversations(table.collect())
    none = conversations.repaired_conversations(table.limit(0), conversations.damaged(table.limit(0)))
    assert none.collect() == []


def test_repaired_rows_have_their_texts(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", " ")]
    lines, figures = conversations.repair(conversations.clean(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert [tuple(r)[1:] for r in lines.orderBy("place").collect()] == [(0, "system", "Be kind."), (1, "user", ""), (2, "assistant", "Hello.")]
    assert [(r.cost, r.audit, r.blank, r.duplicate) for r in figures.collect()] == [(8, "KIKDD", 1, 1)]
