"""Training-data operators against brute force, exact round trips, held-out accuracy and awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row, functions as F, types as T

from cinderframe.llm import _frames, _seating, chat_format, decontaminate, fingerprints, language_id, lm_score, near_dedup, source_mix, substring_dedup, token_files, url_filter
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("id", "key", "text_key", "bucket", "size", "node", "words")]])
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    texts = [None, "", "   \n\t", "one", "One two three.", LONG, LONG + " more words here", "Ünïcode ñandú 日本語. Zweite Zeile!\nDritte", "One two three.", "!!! 123 ---"]
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else None, None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "one two three four five six", None, None, 3), (None, None, None, None, None), (7, "another text with the same id", "de", "s2", 1)]
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10"), (2, "ONE, two"), (None, "dritte"), (4, None), (5, "")], "item_id long, text string")


@pytest.mark.parametrize("module", [decontaminate, url_filter, chat_format, source_mix, near_dedup, substring_dedup])
def test_query_equals_sql(spark, module):
    con = connect(SF)
    for name, sql in module.SQL.items():
        compare(module.QUERIES[name](spark, SF), con, sql)


# substring dedup


def brute_sentences(t):
    """Words, first word of every sentence and behind the last, word by word."""
    found = list(re.finditer(r"[^\x20\x09-\x0D]+", t or ""))
    words = [m[0].encode().lower() for m in found]
    ends = []
    for k, (m, w) in enumerate(zip(found, words, strict=True)):
        gap = t[m.end() : found[k + 1].start()] if k + 1 < len(found) else "\n"
        if w[-1:] in b".!?" or "\n" in gap:
            ends.append(k + 1)
    first = [0]
    for end in ends:
        begin = first[-1]
        first += [k + 1 for k in range(begin, end) if k + 1 - begin >= 8 and end - k - 1 >= 8 and (sum(words[k]) + sum(words[k - 1])) % 4 == 0]
        first.append(end)
    return found, words, first


def in_order(docs):
    return sorted(docs, key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5((x[1] or "").encode()).hexdigest()))


def brute_spans(docs, least=16):
    """From each sentence on, and up to each, the fewest, two at least, with `least` words."""
    seen, out = set(), {}
    for i, t in in_order(docs):
        found, words, first = brute_sentences(t)
        n, gone, spans = len(first) - 1, set(), set()
        long = lambda x, y: y - x >= 2 and first[y] - first[x] >= least
        for x in range(n):
            y = next((y for y in range(x + 2, n + 1) if long(x, y)), n if x == 0 else None)
            if y is not None:
                spans.add((x, y))
            back = next((z for z in range(x - 1, -1, -1) if long(z, x + 1)), None)
            if back is not None:
                spans.add((back, x + 1))
        for x, y in sorted(spans):
            span = tuple(words[first[x] : first[y]])
            if span in seen:
                gone |= set(range(x, y))
            seen.add(span)
        cuts = [0, *(found[k].start() for k in first[1:-1]), len(t or "")] if n else []
        kept = "".join(t[cuts[k] : cuts[k + 1]] for k in range(n) if k not in gone) if n else t or ""
        out[i] = (n or int(bool(t)), len(gone), kept)
    return out


def covered_by_all_runs(docs, cut_alike, least=16):
    """How many sentences a later occurrence of any run covers: runs with `least` words, else of a whole text; runs of
    the same words that are the same sentences, or any."""
    seen, out = set(), {}
    for i, t in in_order(docs):
        _, words, first = brute_sentences(t)
        n, cover = len(first) - 1, set()
        runs = [(x, y) for x in range(n) for y in range(x + 2, n + 1) if first[y] - first[x] >= least] or [(0, n)]
        for x, y in runs:
            key = hash(tuple(words[first[x] : first[y]])), tuple(f - first[x] for f in first[x : y + 1]) if cut_alike else None
            if key in seen:
                cover |= set(range(x, y))
            seen.add(key)
        out[i] = len(cover)
    return out


def test_shortest_spans_stand_for_every_run(spark):
    """Hashing all runs, of any number of sentences, covers the same sentences; those of the same words in other lines may add some."""
    docs = [(r.doc_id, (r.text or "")[:1500]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = np.random.default_rng(3)
    for i in range(60):  # passages of a few sentences, of any length, from one text in another
        s = docs[int(rng.integers(len(docs)))][1].split(". ")
        k, m = int(rng.integers(len(s))), int(rng.integers(1, 6))
        docs.append((10_000 + i, f"Start of {i}. {'. '.join(s[k : k + m])}. End of {i}."))
    got = {r.doc_id: r.n_removed for r in substring_dedup.drop_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    alike, same_words = covered_by_all_runs(docs, True), covered_by_all_runs(docs, False)
    assert all(alike[i] <= n <= same_words[i] for i, n in got.items())
    assert sum(alike[i] == n for i, n in got.items()) > 0.95 * len(got) and sum(got[i] for i in got if i >= 10_000) > 50


def test_spans_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = substring_dedup.op1_substring_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in got} == brute_spans(docs)


def test_frequent_spans_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 50)  # spans with more than a fiftieth of the places go by broadcast
    test_spans_against_brute_force(spark)


def test_repeated_passage_goes_from_all_but_the_first(spark):
    passage = " ".join(f"word{i}" for i in range(60)) + "."
    docs = spark.createDataFrame([(i, f"Own start of number {i} here.\n{passage}\nOwn end {i}.") for i in range(5)], "doc_id long, text string")
    for r in substring_dedup.drop_repeated_spans(docs).collect():
        assert ("word59" in r.text) == (r.doc_id == 0) and f"Own end {r.doc_id}." in r.text


def test_passage_of_fifty_words_behind_any_lead_in(spark):
    """A passage without stops, in the middle of a line, behind 0 to 15 other words: most of it goes from all but the first."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    passage = [word() for _ in range(50)]
    rows = [(100 * p + k, " ".join([*(word() for _ in range(k)), *(x + str(p) for x in passage), *(word() for _ in range(20))])) for p in range(8) for k in range(16)]
    got = {r.doc_id: r.text for r in substring_dedup.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = []
    for i, t in rows:
        p = i // 100
        own = sum(w in got[i].split() for w in (x + str(p) for x in passage))
        if i % 100 == 0:
            assert got[i] == t
        else:
            assert len(got[i].split()) >= i % 100 + 20  # words around the passage stay
            left.append(own)
    assert max(left) <= 30 and sum(left) / len(left) <= 15


def test_spans_leave_one_small_table(spark, monkeypatch, tmp_path):
    """Tables and shuffles that no later step reads are gone before the texts are shuffled."""
    monkeypatch.setattr(_frames, "shared_folder", lambda spark: str(tmp_path))
    got = substring_dedup.op1_substring_dedup(spark, SF)
    assert len(list(tmp_path.glob("spans-*/*"))) == 1 and got.count() == 200
    assert spark.conf.get(_frames.CLEAN, None) is None


def test_spans_of_odd_rows(spark, odd, none):
    got = substring_dedup.drop_repeated_spans(odd).collect()
    assert len(got) == odd.count() and substring_dedup.drop_repeated_spans(none).count() == 0
    by_id = {r.doc_id: r for r in got}
    assert {(by_id[i].n_sentences, by_id[i].n_removed, by_id[i].text) for i in (0, 1)} == {(0, 0, "")} and by_id[2].text == "   \n\t" and by_id[2].n_sentences == 1
    assert [(r.n_removed, r.text) for r in got if r.doc_id == 4] == [(0, "One two three.")] * 3  # one document, repeated
    assert by_id[8].n_removed == by_id[8].n_sentences and by_id[8].text == ""  # a copy of it under another id
    assert by_id[5].n_removed == 0 and by_id[6].text.endswith("more words here") and by_id[6].n_removed >= by_id[6].n_sentences - 4


# near duplicates


def brute_components(docs, words, percent=80):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in docs]
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a][1] & sets[b][1])
            if n and 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
                top[max(find(a), find(b))] = min(find(a), find(b))
    groups: dict[int, list] = {}
    for a in range(len(sets)):
        groups.setdefault(find(a), []).append(sets[a][0])
    return sorted((i, len(s), min((x for x in groups[find(a)] if x is not None), default=None)) for a, (i, s) in enumerate(sets) if i is not None)


@pytest.mark.parametrize("small", [64, 2])
def test_chains_of_near_copies(spark, small):
    """Members that are no near copies of each other hang together; long lists are compared in blocks."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    docs, text = [], base
    for i in range(40):
        text = list(text)
        text[rng.integers(0, 120)] = f"e{i}"
        docs.append((i, " ".join(text if i % 2 else [x if rng.random() > 0.03 else f"n{i}" for x in base])))
    docs += [(100 + i, " ".join(f"u{i}_{k}" for k in range(30))) for i in range(5)] + [(200, docs[3][1]), (201, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, words=4, small=small, block=8).collect())
    assert got == brute_components(docs, 4)


def test_every_twentieth_document_against_all(spark):
    """All links of the documents whose id is divisible by 20, found by brute force, are inside components."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.text or "").encode().lower().split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()) for i, w in docs.items()}
    of = {r.doc_id: r.component_id for r in near_dedup.op10_near_dedup(spark, sf).collect()}
    links = [(a, b) for a in sets if a % 20 == 0 and sets[a] for b in sets if a != b and sets[b] and 100 * (n := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    assert links and all(of[a] == of[b] for a, b in links)


def test_blocks_of_long_lists_find_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, small=1, rounds=0, block=4).collect()} == want


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None) == brute_components([(r.doc_id, r.text) for r in odd.collect()], 5)
    assert near_dedup.near_duplicates(none).count() == 0


# decontamination


def test_matches_of_odd_rows(spark, odd, none, bench):
    found = decontaminate.find_matches(odd, bench).collect()
    rows = {(r.doc_id, r.n_words): r for r in found}
    long = rows[5, 30_000]
    assert long.items == ["1"] and max(s.n_words for s in long.spans) == 11 and long.n_hit >= 11
    assert rows[4, 3].items == ["2"] and rows[4, 3].n_hit == 2 and rows[3, 1].n_hit == 0
    assert [r.items for r in found if r.doc_id == 7 and r.n_hit] == [[]]  # an item without an id
    assert rows[1, 0].n_hit == 0 and rows[0, 0].n_hit == 0
    assert sorted(r.doc_id for r in decontaminate.decontaminate(odd, bench).filter("doc_id is not null").collect()) == [0, 1, 2, 3, 7, 9]
    assert decontaminate.find_matches(none, bench).count() == decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.limit(0)).count() == odd.count()


def test_matches_against_brute_force(spark):
    """Texts of three words, so that windows overlap, repeat and end inside items: hits, items and longest matches."""
    rng = np.random.default_rng(11)
    text = lambda n: " ".join(rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1]))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(40)]
    items = [(i, text(int(n))) for i, n in enumerate([3, 5, 8, 9, 12, 12, 20, 0])]
    items += [(8, items[4][1]), (9, " ".join(docs[0][1].split()[2:20]))]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    tests = [(str(i), t.split()) for i, t in items if t]
    for r in decontaminate.find_matches(frame(docs, "doc_id"), frame(items, "item_id"), window=6).collect():
        w = dict(docs)[r.doc_id].split()
        hit, found, best = set(), set(), {}
        for name, t in tests:
            m = min(6, len(t))
            for j in range(len(t) - m + 1):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == t[j : j + m]:
                        hit |= set(range(p, p + m))
                        found.add(name)
                        n = next(k for k in range(m, len(w) + 1) if p + k == len(w) or j + k == len(t) or w[p + k] != t[j + k])
                        best[p] = max(best.get(p, 0), n)
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(found))
        assert [(s.doc_word, s.n_words) for s in r.spans] == [(p, n) for p, n in sorted(best.items()) if not (p - 1 in best and n <= best[p - 1] - 1)]
        assert all(w[s.doc_word : s.doc_word + s.n_words] == dict(tests)[s.item_id][s.item_word : s.item_word + s.n_words] for s in r.spans)


def test_passes_add_up(spark, odd, bench, monkeypatch):
    one = decontaminate.find_matches(odd, bench).drop("spans").collect()
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 20)
    assert sorted(map(str, decontaminate.find_matches(odd, bench).drop("spans").collect())) == sorted(map(str, one))


# token files


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 20])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), 1000, bits) == ids).all()
    if bits == 16:
        flat = np.packbits((ids[:, None] >> np.arange(16, dtype=np.uint32)) & 1, bitorder="little").tobytes()
        assert token_files.pack(ids, 16) == flat


def test_random_access(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (1, 0, 9000, 3, 4096)]
    path = tmp_path / "x.tok"
    path.write_bytes(token_files.to_file([3, None, 5, 6, 9], [len(x) for x in docs], np.concatenate(docs), 16, 1000))
    with path.open("rb") as f:
        file = token_files.TokenFile(f)
        assert file.doc_ids == [3, None, 5, 6, 9]
        for k in (4, 2, 0, 1, 3):
            assert (file.document(k) == docs[k]).all()


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tk.encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_of_lines_are_remembered(monkeypatch):
    """A text of several lines that was encoded once asks for nothing new."""
    import public_tokenizers

    encode = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    missed, missing = [], token_files._Pieces.__missing__
    monkeypatch.setattr(token_files._Pieces, "__missing__", lambda self, piece: (missed.append(piece), missing(self, piece))[1])
    text = "One line of words.\nAnother line\nand words"
    ids = encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == reference_ids(text)[:-1] and missed
    missed.clear()
    assert encode(text) == ids and not missed


def test_token_table_against_the_library(spark, odd, none):
    got = token_files.token_table(odd).orderBy("start").collect()
    order = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in order]
    want = Counter()
    for i, t in order:
        ids = np.array(reference_ids(t), "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert token_files.token_table(none).count() == 0


@pytest.mark.parametrize("text", ["a  b", "\n x", "don't stop, it's 5.3%!\tnaïve  ", "x\ny z\n", "İstanbul ǅ ª º aª ²x", "日本 語", "a b c", "<|endoftext|> a", "Ünï\nçödé. ok", ""])
def test_pieces_are_what_the_library_gives(text):
    import public_tokenizers

    assert token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))(text) == np.array(reference_ids(text)[:-1], "<u4").tobytes()


# fingerprints


def test_edited_texts(spark, odd, none):
    docs = sorted({(r.doc_id, r.text or "") for r in odd.collect()}, key=lambda x: (x[0] is None, -(x[0] or 0), hashlib.md5(x[1].encode()).hexdigest()))
    got = {(r.doc_id, r.n_chars): r for r in fingerprints.edited_fingerprints(odd).collect()}
    for k, (i, t) in enumerate(docs):
        n = len(t) // 3
        edited = t[: len(t) - n] + docs[(k + 1) % len(docs)][1][:n]
        assert got[i, len(t)].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert fingerprints.edited_fingerprints(odd).count() == odd.count()
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_fingerprints_against_brute_force(spark):
    import xxhash

    def lanes(text):
        identity, ones, n = [0] * 16, [0] * 64, 0
        for paragraph in text.split("\n"):
            digest = hashlib.sha512(paragraph.encode()).hexdigest()
            identity = [(a + int(digest[8 * i : 8 * i + 8], 16)) % 2**32 for i, a in enumerate(identity)]
            words = [w.encode() for w in paragraph.split(" ") if w]
            runs = [words] if len(words) == 1 else list(zip(words, words[1:], strict=False))
            for run in runs:
                h = 42
                for w in run:
                    h = xxhash.xxh64_intdigest(w, h)
                ones = [a + (h >> i & 1) for i, a in enumerate(ones)]
                n += 1
        return identity, ones, n

    def alike(a, b):
        if a == b:
            return 1.0
        x, y = ([2 * k - fp[2] for k in fp[1]] for fp in (a, b))
        norm = math.sqrt(sum(k * k for k in x) * sum(k * k for k in y))
        return max(0.0, min(1.0, sum(p * q for p, q in zip(x, y, strict=True)) / norm)) if norm else 0.0

    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.op4_fingerprints(spark, SF).collect()}
    for k in range(0, len(docs), 7):
        (i, text), (_, after) = docs[k], docs[(k + 1) % len(docs)]
        cut = len(text) // 3
        own, edited, other = lanes(text), lanes(text[: len(text) - cut] + after[:cut]), lanes(after)
        shown = lambda fp: "".join(f"{x:08x}" for x in (*fp[0], *fp[1], fp[2]))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (shown(own), shown(edited))
        assert got[i].near_edited == pytest.approx(alike(own, edited)) and got[i].near_next == pytest.approx(alike(own, other))


def test_fingerprints_are_homomorphic(spark):
    rows = [(1, "aa bb\ncc dd ee\nff"), (2, "ff\naa bb\ncc dd ee"), (3, "aa bb\nff"), (4, "cc dd ee"), (5, "aa bb\ncc dd ef\nff")]
    f = {r.doc_id: r for r in fingerprints.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert f[1].fingerprint == f[2].fingerprint != f[5].fingerprint
    x = fingerprints.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "fp")
    both = x.filter("doc_id = 3").select(F.col("fp").alias("a")).join(x.filter("doc_id = 4").select(F.col("fp").alias("b")), F.lit(True))
    whole = x.filter("doc_id = 1").select(F.col("fp").alias("c"))
    made = both.join(whole, F.lit(True)).select(fingerprints.fingerprint_text(fingerprints.combine(F.col("a"), F.col("b"))).alias("up"), fingerprints.fingerprint_text(fingerprints.combine(F.col("c"), F.col("b"), -1)).alias("down")).first()
    assert made.up == f[1].fingerprint and made.down == f[3].fingerprint


# url filter


def test_rules(spark):
    urls = [None, "no scheme", "http://", "http://EXAMPLE.com/en/7?x", "https://a.b.example.com/en/8#y", "http://notexample.com/en/71", "ftp://x.net?de", "http://a.example.net/de/81", "http://com/en/", "http://x.org/es/://com/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], None)], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_filter.RULES + [(None, "/", "block"), ("com", "/en/", "allow")], "host string, path string, verdict string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect())
    assert got == Counter([(0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "example.com", "/en/7", "example.com/en/7", "allow"), (3, "example.com", "/en/7", "example.com/en/7", "allow"), (4, "a.b.example.com", "/en/8", "com/en/", "block"), (5, "notexample.com", "/en/71", "com/en/", "block"), (6, "x.net", "", None, "allow"), (7, "a.example.net", "/de/81", "example.net/de/8", "allow"), (8, "com", "/en/", "com/en/", "block"), (9, "x.org", "/es/://com/en/", "org/es/", "block")])
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_verdicts_of_the_contract(spark, tmp_path):
    """Each of the contract's rules with its word, on a host of its own and on a subdomain."""
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = [(f"http://{sub}{rule}1", rule) for rule in rules for sub in ("", "a.")]
    spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.op5_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: (rule, rules[rule]) for i, (_, rule) in enumerate(urls)}


# language


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = language_id.ByteNetwork(["a", "b", "c"], hidden=3)
    net.w = {k: w.astype(np.float64) for k, w in net.w.items()}
    x, y = rng.integers(97, 123, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    g, _ = net.gradients(x, y)
    for k in ("uf", "ub", "xf", "xb", "o"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        losses = []
        for step in (1e-3, -2e-3):
            net.w[k][at] += step
            losses.append(net.gradients(x, y)[1])
        net.w[k][at] += 1e-3
        assert g[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=0.05)


def test_predictions_against_a_plain_forward_pass():
    """Position by position, as the equations of the network are written."""
    net = language_id.ByteNetwork(["a", "b", "c"], hidden=4)
    n, w = 4, {k: x.astype(np.float64) for k, x in net.w.items()}
    texts = [b"Some words, and more of them; long enough for two pieces of sixty-four bytes.", "ñandú 日本".encode(), b"12 -", b""]

    def states(piece, side):
        h, out = np.zeros(n), {}
        for t in range(len(piece)) if side == "f" else reversed(range(len(piece))):
            x, u = w[f"x{side}"][:, piece[t]], w[f"u{side}"] @ h
            z, r = (1 / (1 + np.exp(-(x[k * n : k * n + n] + u[k * n : k * n + n]))) for k in (0, 1))
            h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :])
            out[t] = h
        return out

    for text, got in zip(texts, net.predict(texts), strict=True):
        low, total = text.lower(), []
        for i in range(0, len(low), language_id.PIECE):
            piece = low[i : i + language_id.PIECE].ljust(language_id.PIECE, b"\0")
            f, b = states(piece, "f"), states(piece, "b")
            for t, x in enumerate(piece):
                if 97 <= x <= 122 or x >= 128:
                    e = np.exp(w["o"] @ np.concatenate((f[t], b[t], [1.0])))
                    total.append(e / e.sum())
        assert got == pytest.approx(np.mean(total, axis=0) if total else np.zeros(3), abs=2e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.op6_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_of_odd_rows(spark, odd, none):
    net = language_id.train(odd, steps=3)
    rows = language_id.predict_language(odd, net).collect()
    assert len(rows) == odd.count()
    got = {(r.doc_id): r for r in rows}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 9)) and got[3].lang_pred != "und"
    assert language_id.train(none) is None
    assert {r.lang_pred for r in language_id.predict_language(odd, None).collect()} == {"und"}
    assert language_id.keep_languages(none, None).count() == 0
    assert language_id.keep_languages(odd, net, 0.0).columns == odd.columns


# chat


def test_round_trip_of_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "%3Cs>", "%25", "100%", "%", "<s>[INST] user [/INST]x</s>", None, "", "</s", "a</s></s>b", "%%3C5B"]
    rows = [(1, i, r, t, "x") for i, (t, r) in enumerate(zip(texts, ["user", "assistant", " [/INST]", None, "</s>", "%5B", "user", "assistant", "assistant", "assistant", "user"], strict=True))]
    rows += [(None, None, "user", "lost", "x"), (2, 0, "assistant", "same", "x"), (2, 0, "assistant", "same", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in done.select("*", chat_format.parse(F.col("formatted")).alias("turns")).collect()}
    assert all(r.round_trip for r in got.values()) and len(got) == 3
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for _, _, r, t, _ in rows[:11]]
    assert "100%" in got[1].formatted and len(got[2].turns) == 2
    live = chat_format.format_conversations(spark.createDataFrame([(1, 0, "user", "x [/INST] y <s>[INST] z")], "conv_id long, turn long, role string, text string")).first().formatted
    assert live.count("[INST]") == live.count("<s>") == live.count("[/INST]") == live.count("</s>") == 1
    for r in got.values():
        want = [t.text for t in r.turns if t.role == "assistant"]
        read = [r.formatted[s.start : s.start + s.n_chars] for s in r.loss_spans]
        assert [x.replace("%3C", "<").replace("%5B", "[").replace("%25", "%") for x in read] == want
    assert chat_format.format_conversations(df.limit(0)).count() == 0


# language model


def test_seating_has_the_exact_distribution():
    """Tables of a dish of five customers, alone in its restaurant, after many Gibbs steps against all seatings."""
    c, d, strength, parent, n = 5, 0.6, 0.8, 0.3, 20_000
    stirling = {(0, 0): 1.0}
    for k in range(1, c + 1):
        for t in range(1, k + 1):
            stirling[k, t] = stirling.get((k - 1, t - 1), 0.0) + (k - 1 - d * t) * stirling.get((k - 1, t), 0.0)
    weight = np.array([stirling[c, t] * parent**t * math.prod(strength + d * i for i in range(t)) for t in range(1, c + 1)])
    level = _seating.Level(np.arange(n, dtype=np.uint64) << np.uint64(8), d, strength)
    rng = np.random.default_rng(3)
    level.follow(np.full(n, c), np.full(n, parent), rng)
    for _ in range(6):
        level.move(c, np.full(n, parent), rng)
    assert level.c.tolist() == [c] * n and level.size.sum() == c * n and level.t.sum() == len(level.size)
    assert np.bincount(level.t, minlength=c + 1)[1:] / n == pytest.approx(weight / weight.sum(), abs=0.012)
    level.follow(np.arange(n) % 3, np.full(n, parent), rng)
    assert (level.c == np.arange(n) % 3).all() and ((level.t > 0) == (level.c > 0)).all()


def test_every_customer_moves_in_a_sweep(monkeypatch):
    """All customers of large dishes leave once a sweep; from a bad start their tables grow as when one moves at a time."""
    c, n, tables = 400, 1500, {}
    for groups in (16, c):
        level = _seating.Level(np.arange(n, dtype=np.uint64) << np.uint64(8), 0.6, 0.8)
        level.one_table_each(np.full(n, c))
        rng, left, leave = np.random.default_rng(4), [], _seating.Level.leave
        with monkeypatch.context() as patch:
            patch.setattr(_seating.Level, "leave", lambda self, m, rng: (left.append(int(m.sum())), leave(self, m, rng))[1])
            for _ in range(5):
                level.move(groups, np.full(n, 0.9), rng)
        assert sum(left) == 5 * c * n and level.c.tolist() == [c] * n and level.size.min() > 0 and level.size.sum() == c * n
        tables[groups] = level.t.mean()
    assert tables[16] == pytest.approx(tables[c], rel=0.06) and tables[c] > 4


def seated(n, c):
    """n dishes, every fifth empty, in restaurants of 50, with up to c customers each."""
    level = _seating.Level(np.arange(n, dtype=np.uint64) // np.uint64(50) * np.uint64(256) + np.arange(n, dtype=np.uint64) % np.uint64(50), 0.6, 0.8)
    rng = np.random.default_rng(5)
    level.follow(np.where(np.arange(n) % 5, rng.integers(0, c, n), 0), np.full(n, 0.4), rng)
    return level


def test_seating_goes_by_steps(monkeypatch):
    """Steps of any size draw the same seats, and a step's arrays, not those of all tables, are what is held."""
    made = []
    for tables in (40, 1 << 30):
        monkeypatch.setattr(_seating, "STEP_TABLES", tables)
        level = seated(1000, 120)
        level.move(16, np.full(1000, 0.4), np.random.default_rng(6))
        made.append((level.c.tolist(), level.t.tolist(), level.size.tolist()))
    assert made[0] == made[1] and sum(made[0][2]) == sum(made[0][0]) and made[0][1][0] == 0
    monkeypatch.undo()
    level = _seating.Level(np.arange(2000, dtype=np.uint64) << np.uint64(8), 0.6, 0.8)
    level.c, level.t, level.size = np.full(2000, 800), np.full(2000, 400), np.full(800_000, 2)
    rng, base = np.random.default_rng(7), np.full(2000, 0.4)
    for step in (lambda: level.leave(np.full(2000, 50), rng), lambda: level.sit(np.full(2000, 50), base, rng)):
        tracemalloc.start()
        step()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 3 * level.size.nbytes  # the new sizes, once in pieces; before: 5 and more
    ends = np.cumsum(level.t)
    assert np.diff(np.cumsum(level.size)[ends - 1], prepend=0).tolist() == level.c.tolist() == [800] * 2000


def test_runs_and_their_counts(monkeypatch):
    """Runs of every order and their numbers, sorted and merged in pieces, as Python counts them."""
    texts = [lm_score.symbols(x) for x in (b"A bc a", b"", "\u00e9t\u00e9 \u4e2d".encode(), b"a bc a bc")]
    for order in range(2, 7):
        want = [(i, int.from_bytes((b"\t" * order + x)[k : k + order + 1], "big")) for i, x in enumerate(texts) for k in range(len(x))]
        doc, keys = lm_score.runs(texts, order)
        assert list(zip(doc.tolist(), keys.tolist(), strict=True)) == want
    assert [len(x) for x in lm_score.runs([], 6)] == [0, 0]
    monkeypatch.setattr(lm_score, "SORT", 50)
    monkeypatch.setattr(lm_score, "MERGE", 30)
    rng, counts, want = np.random.default_rng(8), lm_score._Counts(), Counter()
    for _ in range(40):
        keys, count = rng.integers(0, 60, 23).astype(np.uint64), bool(rng.random() < 0.7)
        counts.see(keys, count)
        want.update(keys.tolist() if count else dict.fromkeys(keys.tolist(), 0))
    keys, c = counts.merged()
    assert dict(zip(keys.tolist(), c.tolist(), strict=True)) == dict(want) and keys.tolist() == sorted(want)


class BruteModel:
    """One customer at a time: every byte of every training text leaves and sits down anew, with tables as lists."""

    def __init__(self, order, discount, strength, seed):
        self.order, self.d, self.s, self.rng, self.rooms = order, discount, strength, np.random.default_rng(seed), {}

    def p(self, context, x):
        base = self.p(context[1:], x) if context else 1 / lm_score.SYMBOLS
        return self.given(context, x, base)

    def given(self, context, x, base):
        room = self.rooms.get(context, {})
        tables, seated = sum(map(len, room.values())), sum(map(sum, room.values()))
        own = room.get(x, [])
        return (sum(own) - self.d * len(own) + (self.s + self.d * tables) * base) / (self.s + seated)

    def sit(self, context, x):
        base = self.p(context[1:], x) if context else 1 / lm_score.SYMBOLS
        room = self.rooms.setdefault(context, {})
        own = room.setdefault(x, [])
        weights = np.array([*(n - self.d for n in own), (self.s + self.d * sum(map(len, room.values()))) * base])
        k = self.rng.choice(len(weights), p=weights / weights.sum())
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            if context:
                self.sit(context[1:], x)

    def leave(self, context, x):
        own = self.rooms[context][x]
        k = self.rng.choice(len(own), p=np.array(own) / sum(own))
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            if context:
                self.leave(context[1:], x)


def test_scores_against_one_customer_at_a_time(spark):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join("".join(rng.choice(list("abc"), 3, p=[0.6, 0.3, 0.1])) for _ in range(4 + i % 3))) for i in range(20)]
    kept = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in docs}
    assert 0 < sum(kept.values()) < 20
    places = {i: [(tuple(x[k - 2 : k]), x[k]) for x in [b"\t\t" + lm_score.symbols(t.encode())] for k in range(2, len(x))] for i, t in docs}
    model, sums, n = BruteModel(2, 0.5, 1.0, 0), Counter(), 60
    train = [x for i, _ in docs if kept[i] for x in places[i]]
    for x in train:
        model.sit(*x)
    for sweep in range(n + 20):
        for x in train:
            model.leave(*x)
            model.sit(*x)
        if sweep >= 20:
            for x in {x for own in places.values() for x in own}:
                sums[x] += model.p(*x) / n
    got = {r.doc_id: r.score for r in lm_score.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), sweeps=120, burn_in=20, sampled=False, order=2).collect()}
    want = {i: sum(math.log10(sums[x]) for x in own) for i, own in places.items()}
    assert got == pytest.approx(want, rel=0.04)  # the few restaurants behind one byte are sampled from one seating


def test_scores(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in docs}
    count: Counter = Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    rows = lm_score.op8_lm_score(spark, SF).collect()
    for r in rows:
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) and r.score < 0
    for some in ([r for r in rows if not r.held_out], [r for r in rows if r.held_out and r.n_known == r.n_tokens]):
        assert some and sum(r.score for r in some) > sum(r.base_score for r in some)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: r for r in lm_score.score_documents(docs.repartition(4)).collect()}
    assert {r.doc_id: r for r in lm_score.score_documents(docs.repartition(7)).collect()} == want


def test_scores_of_odd_rows(spark, odd, none):
    rows = lm_score.score_documents(odd).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert len({r.score for r in rows if r.doc_id == 4}) == 1 and all(r.score < 0 for r in rows)
    assert lm_score.score_documents(none).count() == 0


@pytest.fixture(scope="module")
def four_scores(spark):
    """Scores of four held-out texts of twelve words: in the corpus's order, shuffled, of rare known words, of random letters."""
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 != 2][:150]
    kept = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rng = np.random.default_rng(1)
    syllables = ["ba", "ne", "ti", "lo", "mur", "sen", "kal", "dor"]
    words = sorted({"".join(rng.choice(syllables, 3)) for _ in range(300)})
    line, rare = words[:12], words[12:24]
    docs = [(i, " ".join([*line, words[24 + k % 200]])) for k, i in enumerate(ids)] + [(ids[0], " ".join(rare))]
    noise = ["".join(rng.choice(list("qxzjvwkfgyhp"), len(w))) for w in rare]
    docs += [(i, " ".join(x)) for i, x in zip(kept, [line, line[::-1], rare[::2] + rare[1::2], noise], strict=True)]
    got = {r.doc_id: r.score for r in lm_score.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.held_out}
    return [got[i] for i in kept]


def test_order_of_words_counts(four_scores):
    ordered, backwards, _, _ = four_scores
    assert ordered > backwards + 6


def test_random_letters_score_below_words_of_the_corpus(four_scores):
    assert four_scores[3] < four_scores[2] - 6


# mixing


def test_targets_are_shared_until_none_is_above(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, None: 500}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in source_mix.targets(df, (5, 2, 1), 1.0, 3).collect()}
    weight, cap, want = {"a": 5, "b": 2, "c": 1, None: 5}, {k: 3 * v for k, v in sizes.items()}, {}
    left, open_ = float(sum(sizes.values())), set(sizes)
    while True:
        share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        over = {k for k in open_ if share[k] > cap[k]}
        if not over:
            want |= share
            break
        want |= {k: cap[k] for k in over}
        left -= sum(cap[k] for k in over)
        open_ -= over
    assert got == pytest.approx(want)


def test_mix_of_odd_rows(spark, odd, none):
    rows = source_mix.mix_report(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    total = sum(r.size for r in rows)
    assert abs(sum(r.taken for r in rows) - total) <= 4
    assert sorted(map(str, source_mix.mix_report(odd.repartition(3)).collect())) == sorted(map(str, rows))
    assert source_mix.mix_report(none).count() == source_mix.mixed_documents(none).count() == 0
    assert source_mix.mixed_documents(odd).columns == odd.columns


# pipeline


def test_language_stage_without_labels(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words", None), (2, "12 -", None), (3, None, None), (4, "ñ", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()) == [1, 4]


def test_run_writes_each_stage(spark, monkeypatch):
    import corpus_pipeline

    read = []

    def stage(spark, docs, sf_dir):
        read.append(docs.inputFiles()[0])
        return docs.select("doc_id", F.lit(len(read)).alias("n"))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage), ("c", stage)])
    out = corpus_pipeline.run(spark, SF)
    assert {r.n for r in out.collect()} == {3} and out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert "documents.parquet" in read[0] and all("/pipeline-" in x for x in [read[1], read[2], out.inputFiles()[0]])


def test_near_dedup_stage_decides_by_row(spark):
    import corpus_pipeline

    text = [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(6)]
    near = f"{text[0]} end"
    rows = [
        (1, text[0], "a"), (None, near, "a"),  # a null id that is a near copy of a document
        (None, text[1], "a"), (None, text[1] + " end", "a"),  # a group without ids
        (None, text[2], "a"), (None, None, "a"), (None, "", "a"),  # single rows; null and empty are one text
        (5, near, "a"), (5, text[3], "a"),  # one id, two texts, one of them a copy
        (6, text[4], "b"), (6, text[4], "a"), (6, text[4], "b"),  # repeated rows
        (8, text[5], "a"), (8, text[5] + " end", "a"),  # near copies under one id
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns

    def smaller(*texts):
        return min(texts, key=lambda t: hashlib.md5(t.encode()).hexdigest())

    want = [(1, text[0], "a"), (None, smaller(text[1], text[1] + " end"), "a"), (None, text[2], "a"), (None, None, "a"), (5, text[3], "a"), (6, text[4], "a"), (8, smaller(text[5], text[5] + " end"), "a")]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, kept[-1], SF)
        assert out.columns == docs.columns
        kept.append(spark.createDataFrame(out.collect(), docs.schema))
    language, near, clean, mix = ([(r.doc_id, r.text) for r in x.collect()] for x in kept[1:])
    assert {i for i, t in ((r.doc_id, r.text) for r in docs.collect()) if t and len(t) > 40 and any(c.isalpha() for c in t)} <= {i for i, _ in language}
    assert sorted(i for i, _ in near) == sorted(i for i, _, c in brute_components(language, 5) if i == c)

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    assert sorted(i for i, _ in clean) == sorted(i for i, t in near if not any(tuple(w[k : k + m]) in windows for w in [words(t)] for m in sizes for k in range(len(w) - m + 1)))
    assert max(Counter(i for i, _ in mix).values()) <= 3 and {i for i, _ in mix} <= {i for i, _ in clean}
    assert corpus_pipeline.STAGES[4][1](spark, kept[4], SF).count() == len(mix)


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns go through every stage."""
    import corpus_pipeline

    for docs in (odd, none):
        rows = docs
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, rows, SF)
            assert out.columns == docs.columns
            kept = out.collect()
            if docs is none:
                assert not kept
            elif name == "language":
                assert {r.doc_id for r in kept} <= {3, 4, 5, 6, 7, 8, None}
            elif name == "near_dedup":
                assert Counter((r.doc_id, r.text) for r in kept).most_common(1)[0][1] == 1
            rows = spark.createDataFrame(kept, docs.schema)
        last = corpus_pipeline.STAGES[4][1](spark, rows, SF)
        assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and last.count() == rows.count()
