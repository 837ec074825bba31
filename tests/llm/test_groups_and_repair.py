"""SimHash groups, centroid clusters and repaired conversations against brute force, and their awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from cinderframe.llm import centroids, simhash, turn_repair
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module", [centroids, turn_repair])
def test_query_equals_sql(spark, module):
    for name, sql in module.SQL.items():
        compare(module.QUERIES[name](spark, SF), connect(SF), sql)


# simhash


def brute_print(text, words):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    shingles = [" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    """Smallest label in reach by links of at most two bits; prints maps labels to fingerprints."""
    up = {i: i for i in prints}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: top(i) for i in prints}


def test_simhash_against_brute_force(spark):
    prints = {r.doc_id: brute_print(r.text, 3) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    groups = brute_groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op11_simhash(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", groups[i]) for i, p in prints.items()}


@pytest.mark.parametrize("crowd", [2, 32, 10_000])
def test_links_of_alike_fingerprints(spark, crowd):
    """Fingerprints around a few centres, at 0 to 4 bits from them: chains of links, whether cells are crowded or not."""
    rng = np.random.default_rng(11)
    prints = set()
    for centre in [0, (1 << 64) - 1, 0x5555555555555555, *map(int, rng.integers(0, 1 << 63, 6))]:
        for _ in range(60):
            bits = rng.choice(64, rng.integers(0, 5), replace=False)
            prints.add(centre ^ sum(1 << int(b) for b in bits))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    from cinderframe.llm._frames import Scratch

    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "print long"), Scratch(spark, "t"), crowd).collect()
    assert all((int(a) ^ int(b)) & ((1 << 64) - 1) and ((int(a) ^ int(b)) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in edges)
    want = brute_groups(dict(zip(signed, prints, strict=True)))
    up = {s: s for s in signed}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    assert {s: top(s) for s in signed} == want


def test_simhash_of_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One Two"), (5, "one\ttwo"), (None, "one two"), (None, None), (6, long), (7, long + " end"), (6, long), (None, "alone among others here")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, print string, id string, cell string")
    got = simhash.simhash_groups(docs, words=3).collect()
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(rows) and {of[i].component_id for i in (1, 2, 3)} == {1} and of[1].fingerprint == "0" * 16
    assert of[4].component_id == of[5].component_id == 4 and of[6].component_id == of[7].component_id == 6
    assert of[6].fingerprint == f"{brute_print(long, 3):016x}"
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["1", "4", "None"]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


# centroids


def brute_clusters(vectors, k, rounds, dims):
    """vectors: (id, components); all in Python's integers."""
    kept = [(i, x) for i, x in vectors if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    ints = [[math.floor(Fraction(v) * 1024) for v in x] for _, x in kept]
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, hashlib.sha256(f"3:{kept[j][0]}".encode()).hexdigest(), kept[j][1]))
    centres = [ints[j] for j in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centres)) for x in ints]

    for _ in range(rounds):
        got = assign()
        for n in range(len(centres)):
            mine = [x for x, (_, m) in zip(ints, got, strict=True) if m == n]
            if mine:
                centres[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    got = assign()
    whole = sum(d for d, _ in got)
    top = (1 << 63) - 1
    out = []
    for (i, _), (d, n) in zip(kept, got, strict=True):
        sha = hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()
        out.append((i, n, min(d, top), min(sum(e for e, m in got if m == n), top), min(whole, top), sha))
    return sorted(out, key=str)


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e9, 1e300])
def test_clusters_against_brute_force(spark, scale):
    """Components for which float64, 64-bit integers or only Python's integers are exact, beside rows that do not count."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * (scale if i % 3 else 1.0)).tolist()) for i in range(90)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, [0.5, 0.5, -0.5, 0.25]), (100, None), (101, [1.0, 2.0, 3.0]), (102, [1.0, None, 3.0, 4.0]), (103, [1.0, math.nan, 3.0, 4.0]), (104, [math.inf, 1.0, 1.0, 1.0]), (105, []), (106, [1.7e308, -1.7e308, 0.0, 1.0] if scale > 1e200 else [-0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, x, "a", 1) for i, x in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    got = centroids.clusters(df, dims=4, k=5, rounds=4).collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters(rows, 5, 4, 4)


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = centroids.clusters(df, dims=2).collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters(rows, 8, 10, 2)
    assert centroids.clusters(df.limit(0), dims=2).count() == 0 and centroids.clusters(df, dims=3).count() == 0


# conversations


TURNS = "conv_id long, turn long, role string, text string"


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(k, text)
        out += [(c, t, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def brute_repair(rows):
    """rows: (role, text) in order. Every sequence of edits whose cost is at most the best, by depth-first search."""
    faults, seen = [], set()
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    best = [10**9, None, None]

    def go(i, audit, out, cost):
        if cost > best[0] or (cost == best[0] and best[1] is not None and audit > best[1] and not best[1].startswith(audit)):
            return
        initials = "".join(r[0] for r, _ in out)
        if not re.fullmatch("(s?(ua)*u?)?", initials):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials) and (cost, audit) < (best[0], best[1] if best[1] is not None else "~"):
            best[:] = [cost, audit, out]
        if i < len(rows):
            role, text = rows[i]
            go(i + 1, audit + "D", out, cost + 2)
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] else 0
                if role:
                    go(i + 1, audit + "K", [*out, (role, text)], cost + more)
                for r in ("user", "assistant"):
                    if r[0] != role[:1]:
                        go(i + 1, audit + "R", [*out, (r, text)], cost + 1 + more)
        if len(audit) - sum(x != "I" for x in audit) < 4:
            for r in ("user", "assistant"):
                go(i, audit + "I", [*out, (r, "")], cost + 5)

    go(0, "", [], 0)
    pairs = [a[:1] + b[:1] for (a, _), (b, _) in zip(rows, rows[1:])]
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()
    return (faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], sha)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


def expected(damaged, ids):
    out = []
    for c in ids:
        mine = in_order([r for r in damaged if r[0] == c])
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *brute_repair([r[2:] for r in mine])))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks():
    """Short conversations of every kind of fault: nulls, ties, repeated rows, other roles, gaps."""
    rng = np.random.default_rng(13)
    roles, texts = ["user", "assistant", "system", "tool", None, "ua", ""], ["Yes.", "No!", "cut off", "", "  ", None, "Why? ", "ñ …", "ends\n?\t"]
    rows = []
    for c in [*range(60), None]:
        turn = 0
        for _ in range(int(rng.integers(1, 6))):
            turn += int(rng.integers(0, 3))
            p = [0.35, 0.35, 0.1, 0.05, 0.05, 0.05, 0.05]
            rows.append((c, None if rng.random() < 0.1 else turn, roles[rng.choice(7, p=p)], texts[rng.integers(len(texts))]))
    return rows


def test_repair_against_brute_force(spark, talks):
    df = spark.createDataFrame([(*r, "x", 1) for r in talks], TURNS + ", p string, kind int")
    got = turn_repair.repair_report(turn_repair.damaged(df), df).collect()
    assert sorted(map(tuple, got), key=str) == expected(brute_damage(talks), {r[0] for r in talks})


def test_chunks_give_the_same_repair(spark, talks, monkeypatch):
    """One long conversation, cut into chunks of four rows and whole."""
    rows = [(7, i, r[2] or "user", r[3] or " ") for i, r in enumerate(talks * 3)]
    df = spark.createDataFrame(rows, TURNS)
    whole = turn_repair.repair_report(df, df).collect()
    monkeypatch.setattr(turn_repair, "CHUNK_BITS", 2)
    assert turn_repair.repair_report(df.repartition(3), df).collect() == whole
    edited = turn_repair.repaired_turns(df)[0].collect()
    assert "".join(r.edit for r in edited) == whole[0].audit
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in edited if r.edit != "D"))


def test_repair_of_odd_tables(spark):
    df = spark.createDataFrame([], TURNS)
    assert turn_repair.repair_report(turn_repair.damaged(df), df).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    long = "word " * 400_000 + "end."
    kept = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 > 4 and zlib.crc32(f"{i}:1".encode()) % 20 > 4)
    rows = [(gone, 0, "user", "Hi."), (kept, 0, "user", long), (kept, 1, "assistant", long)]
    got = {r.conv_id: r for r in turn_repair.repair_report(turn_repair.damaged(spark.createDataFrame(rows, TURNS)), spark.createDataFrame(rows, TURNS)).collect()}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got[kept].audit == "KK" and got[kept].repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
    assert T.StructType(turn_repair.repair_report(spark.createDataFrame(rows, TURNS), spark.createDataFrame(rows, TURNS)).schema).names[0] == "conv_id"


# pipeline stages on tables with columns of any name and type


def test_stages_keep_columns_of_any_type_and_name(spark):
    """A map column goes through near_dedup; columns named like helpers come back from source_mix as they were."""
    import corpus_pipeline

    text = [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(3)]
    kind = "doc_id long, text string, source string, m map<string,int>, size long, k int, row string, times int"
    rows = [(1, text[0], "a", {"x": 1}, 5, 6, "r", 7), (1, text[0], "a", {"x": 1}, 5, 6, "r", 7), (2, text[0] + " end", "a", None, 5, 6, "r", 7), (3, text[1], None, {"y": 2}, 8, 9, None, None)]
    docs = spark.createDataFrame(rows, kind)
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted((r.doc_id, r.m) for r in kept.collect()) == [(1, {"x": 1}), (3, {"y": 2})]
    mixed = corpus_pipeline.source_mix(spark, docs, SF)
    assert mixed.columns == docs.columns and {(r.doc_id, r["size"], r.k, r["row"], r.times) for r in mixed.collect()} <= {(r[0], *r[4:]) for r in rows}
