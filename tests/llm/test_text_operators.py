"""The text operators against brute force, with nulls, empty texts, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import bytescan, fingerprint_index, jaccard_join, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, part int, bucket string, hashes string, start string, score double"


def frame(spark, rows, schema=CLASH):
    return spark.createDataFrame([(i, t, 1, "b", "h", "s", 0.5) for i, t in rows], schema).repartition(3)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def noisy(seed, n=240):
    rng = random.Random(seed)
    pool = [chr(97 + i) for i in range(4)] + ["é", "日本"]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "  ", "\n"]).join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        rows.append((i * 3 - 50, None if i % 17 == 0 else "" if i % 19 == 0 else " " * (i % 3) + text + "\t" * (i % 2)))
    return rows


def windows_brute(rows, n):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [0] * len(w)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                gone[i : i + n] = [1] * n
            seen.add(k)
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()))
    return out


@pytest.mark.parametrize(("n", "settings"), [(3, {}), (5, {"batches": 1}), (7, {"batches": 3, "fan": 3}), (5, {"batches": 3, "bits": 4})])
def test_repeated_windows(spark, n, settings):
    """In batches, by two passes of buckets, and with hashes so short that most matches are false."""
    rows = noisy(n)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fingerprint_index.dedup(frame(spark, rows), n=n, **settings).collect()}
    assert got == windows_brute(rows, n)


def test_index_over_batches_and_sessions(spark, tmp_path):
    rows, got, path = noisy(9), {}, f"file://{tmp_path}/index"
    df, index = frame(spark, rows), fingerprint_index.FingerprintIndex(spark, path, n=4, parts=5, fanout=2)
    for a in range(-60, 900, 200):
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in index.ingest(df.filter(f"doc_id >= {a} AND doc_id < {a + 200}")).collect()}
        if a == 340:
            index.compact()
            assert len(index.runs) == index.turns
            index = fingerprint_index.FingerprintIndex(spark, path)  # as a later session would
            assert index.n == 4
    assert got == windows_brute(rows, 4)


def test_one_path_in_several_calls(spark, tmp_path):
    """Texts of former calls are known, also after compaction and in a new session; ids must rise."""
    rows, got, path = noisy(3), {}, f"file://{tmp_path}/index"
    df = frame(spark, rows)
    for a, z in ((-60, 200), (200, 430), (430, 900)):
        found = fingerprint_index.dedup(df.filter(f"doc_id >= {a} AND doc_id < {z}"), n=5, batches=2, path=path)
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()}
        if a == 200:
            fingerprint_index.FingerprintIndex(spark, path).compact()
    assert got == windows_brute(rows, 5)
    with pytest.raises(ValueError, match="holds ids up to"):
        fingerprint_index.dedup(df, n=5, path=path)
    text = " ".join(f"w{i}" for i in range(60))
    other = f"file://{tmp_path}/other"
    fingerprint_index.dedup(frame(spark, [(1, text)]), path=other)
    assert [r.n_removed for r in fingerprint_index.dedup(frame(spark, [(2, "three words before " + text)]), path=other).collect()] == [60]


def test_runs_are_sorted_and_come_back():
    h = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 200_000, dtype=np.uint64))
    docs, starts = np.arange(200_000) * 7 - 5, (np.arange(200_000) % 999).astype(np.int32)
    rows = fingerprint_index.run_rows(3, h, docs, starts)
    assert len(rows) == 4 and sum(r[1] for r in rows) == 200_000
    got = fingerprint_index.read_runs(pa.table({k: [r[i] for r in rows] for i, k in ((2, "hashes"), (3, "run_docs"), (4, "run_starts"))}))
    assert all((a == b).all() for a, b in zip(got, (h, docs, starts), strict=True))


def test_repeated_windows_without_rows_or_ids(spark):
    assert fingerprint_index.dedup(frame(spark, noisy(1)).limit(0)).collect() == []
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "x a b c d")]
    got = sorted(fingerprint_index.dedup(frame(spark, rows), n=3).collect(), key=str)
    assert Counter((r.doc_id, r.n_removed) for r in got) == {(None, 0): 1, (1, 4): 2, (2, 4): 1}


def substrings_brute(rows, size):
    texts = {d: (t or "").encode() for d, t in rows}
    count = Counter(b[i : i + size] for b in texts.values() for i in range(len(b) - size + 1))
    out = {}
    for d, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("size", [16, 40, 64])
def test_repeated_substrings(spark, size):
    rng = random.Random(size)

    def word():
        return "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6)))

    pieces = [" ".join(word() for _ in range(rng.randint(1, 25))) for _ in range(60)] + ["ab " * 40]
    rows = [(i * 3 - 50, None if i % 37 == 0 else " ".join(rng.choice(pieces) if rng.random() < 0.5 else word() for _ in range(rng.randint(0, 14)))) for i in range(250)]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_array.dedup(frame(spark, rows), length=size).collect()}
    assert got == substrings_brute(rows, size)


def test_repeated_substrings_of_nothing(spark):
    assert suffix_array.dedup(frame(spark, []).limit(0)).collect() == []
    with pytest.raises(ValueError, match="length"):
        suffix_array.dedup(frame(spark, noisy(1)), length=201)


@pytest.mark.parametrize("settings", [{"fan": 3}, {"hash_bits": 3}])
def test_substrings_by_two_passes_and_with_false_matches(spark, settings):
    """More buckets than a pass deals to; and hashes so short that digests must tell stretches apart."""
    rng = random.Random(11)
    pieces = ["".join(rng.choice("abcd ") for _ in range(rng.randint(20, 90))) for _ in range(30)]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_array.dedup(frame(spark, rows), length=40, **settings).collect()}
    assert got == substrings_brute(rows, 40)


def test_rows_with_one_id_are_documents_of_their_own(spark):
    shared = "".join(random.Random(3).choice("abcdefgh ") for _ in range(260))
    rows = [(1, "x " + shared), (2, "yy " + shared + " z"), (3, "zzz" + shared), (1, "short"), (None, shared + "!"), (None, None), (4, "only here " * 3), (4, "only here " * 3)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_array.dedup(frame(spark, rows), length=200).collect())
    brute = substrings_brute(list(enumerate(t for _, t in rows)), 200)
    assert got == sorted((str(d), brute[k][0], brute[k][1], brute[k][3]) for k, (d, _) in enumerate(rows))
    assert sum(r[2] for r in got) >= 4 * 260
    equal = sorted((r.doc_id, r.n_removed) for r in suffix_array.dedup(frame(spark, [(7, shared), (7, shared), (8, shared[:250] + "?" * 50)]), length=200).collect())
    assert equal == [(7, 260), (7, 260), (8, 250)]


def test_what_each_step_of_the_suffix_array_finds(spark):
    """Stretches settled by digests and windows among sorted suffixes; together all."""
    rng = random.Random(12)
    pieces = ["".join(rng.choice("abcd ") for _ in range(rng.randint(60, 200))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    removed = {only: sum(r.n_removed for r in suffix_array.dedup(frame(spark, rows), length=64, only=only).collect()) for only in (None, "stretches", "suffixes")}
    assert 0 < removed["stretches"] < removed[None] and 0 < removed["suffixes"] < removed[None]
    assert removed[None] <= removed["stretches"] + removed["suffixes"]


def test_ranges_meet_at_their_ends(spark, monkeypatch):
    """A passage with so many surroundings that its suffixes fill several ranges."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdef ") for _ in range(70))
    rows = [(i, "".join(rng.choice("uvwxyz") for _ in range(rng.randint(20, 60))) + passage[rng.randint(0, 5) :] + "".join(rng.choice("uvwxyz") for _ in range(40))) for i in range(120)]
    monkeypatch.setattr(bytescan, "parts", lambda df, size, least=12, most=1: 12)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_array.dedup(frame(spark, rows), length=64).collect()}
    assert got == substrings_brute(rows, 64)


def test_ranges_meet_where_passages_share_their_first_bytes(spark, monkeypatch):
    """Many passages whose suffixes begin with the same 16 bytes, each in two documents far apart."""
    rng = random.Random(6)

    def letters(pool, n):
        return "".join(rng.choice(pool) for _ in range(n))

    passages = []
    while len(passages) < 30:
        passage = "same first bytes" + letters("abcdef", 48)
        data, off = bytescan.strings(pa.array([passage]))
        if suffix_array.anchors(data, off, 64)[1].tolist() == [0]:  # sorted by its own first bytes
            passages.append(passage)
    rows = [(i, letters("uvwxyz", 40) + passages[i % 30] + letters("uvwxyz", 40)) for i in range(60)]
    monkeypatch.setattr(bytescan, "parts", lambda df, size, least=12, most=1: 12)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_array.dedup(frame(spark, rows), length=64).collect()}
    assert got == substrings_brute(rows, 64)
    assert all(r[1] >= 64 for r in got.values())


def jaccard_brute(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for k in s:
            where[k].append(d)
    for d in sets:
        for e in {e for k in sets[d] for e in where[k] if e > d}:
            both = len(sets[d] & sets[e])
            if 100 * both >= percent * (len(sets[d]) + len(sets[e]) - both):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("n", "percent", "block", "fan"), [(2, 80, 256, 4096), (3, 50, 7, 4096), (5, 80, 16, 3), (2, 60, 3, 4096)])
def test_jaccard_join(spark, n, percent, block, fan):
    """Small blocks make stars of large neighbourhoods; a small fan needs two passes."""
    rng = random.Random(n)
    pool = [chr(97 + i) for i in range(9)] + ["É", "日本"]
    base = [[rng.choice(pool) for _ in range(rng.randint(0, 60))] for _ in range(40)]
    rows = []
    for i in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            if w:
                w[rng.randrange(len(w))] = rng.choice([*pool, "A"])
        rows.append((i * 3 - 50, None if i % 37 == 0 else " ".join(w).replace("a", "A" if i % 2 else "a")))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(frame(spark, rows), n=n, percent=percent, block=block, fan=fan).collect()}
    assert got == jaccard_brute(rows, n, percent)


def test_jaccard_keeps_one_and_all_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (1, text + " end"), (2, "other words entirely here now"), (4, None), (None, text)]
    kept = jaccard_join.keep_representatives(frame(spark, rows).withColumn("__copy", F.lit(7)))
    assert kept.columns[-1] == "__copy"
    assert {r.doc_id for r in kept.collect()} == {1, 2, 4, None}
    assert jaccard_join.join(frame(spark, []).limit(0)).collect() == []


def test_jaccard_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (3, a + " z"), (9, b + " z"), (1, c), (1, c), (None, a), (7, "")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.join(frame(spark, rows)).collect())
    assert got == sorted([("5", 36, "3"), ("5", 36, "3"), ("3", 37, "3"), ("9", 37, "3"), ("1", 36, "1"), ("1", 36, "1"), ("None", 36, "None"), ("7", 0, "7")])


def test_a_large_group_of_near_copies_is_compared_in_stars(spark):
    """Far fewer rows go to tasks of pairs than all pairs of blocks would need."""
    rng = random.Random(13)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, f"other {i} " + " ".join(base[:60])) for i in range(5)]
    got = {r.doc_id: r.component_id for r in jaccard_join.join(frame(spark, rows), block=16).collect()}
    assert got == {d: c for d, (_, c) in jaccard_brute(rows, 5, 80).items()}
    placed = spark.createDataFrame([(0, i, 0 if i < 390 else i, b"", b"") for i in range(400)], "hood long, doc_id long, star long, shingles binary, prefix binary")
    assert jaccard_join._tasks(placed, 16, 4).count() == 390 + 10 * (25 + 1)


def test_very_long_texts(spark):
    """A text far beyond a chunk, with a piece of it as another row, through every operator on texts."""
    from lodestar.llm import langid, mixing, packing, quality, secrets

    rng = random.Random(14)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(600_000)) + " token=0123456789abcdef0123456789abcdef01"
    rows = [(1, long), (2, long[:200_000]), (3, "short"), (4, None)]
    df = frame(spark, rows)
    found = {r.doc_id: r for r in suffix_array.dedup(df).collect()}
    assert (found[1].n_bytes, found[1].n_removed, found[2].n_removed) == (len(long), 200_000, 200_000)
    words = {r.doc_id: r for r in fingerprint_index.dedup(df).collect()}
    assert (words[1].n_words, words[1].n_removed, words[2].n_words, words[2].n_removed) == (600_001, 0, 25_000, 25_000)
    assert {r.doc_id: r.component_id for r in jaccard_join.join(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    pieces = packing.pack(df).filter("doc_id = 1").agg(F.sum("length"), F.max("piece")).first()
    assert pieces[0] > 600_000 and pieces[1] == -(-pieces[0] // 4096) - 1
    assert {r.doc_id: (r.n_assign, r.n_hex) for r in secrets.find(df, secrets.fit(df)).collect()} == {1: (1, 1), 2: (0, 0), 3: (0, 0), 4: (0, 0)}
    assert {r.doc_id: r.size for r in mixing.mix(df.withColumn("source", F.lit("a"))).collect()} == {1: 600_001, 2: 25_000, 3: 1, 4: 0}
    # random letters are no language: what tells is a piece of the text itself
    model = langid.LanguageModel({"aa": long[300_000:330_000].encode(), "bb": " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3750)).encode()})
    assert {r.doc_id: r.language.lang_pred for r in langid.identify(df, model).collect()}[1] == "aa"
    assert quality.features(pa.array([long])).shape == (1, len(quality.NAMES))


def test_parts_are_those_of_spark(spark):
    ids = [0, 1, -5, 2**62, bytescan.NO_ID]
    df = spark.createDataFrame([(i,) for i in ids], "a long").select(F.pmod(F.xxhash64("a"), F.lit(97)).alias("p"))
    assert [r.p for r in df.collect()] == bytescan.part_of(np.array(ids), 97).tolist()


def test_words_and_hashes_do_not_depend_on_place():
    found = []
    for column in (pa.array(["x", None, " one two\tthree ", ""]), pa.array(["one two three"])):
        for _, _, data, off in bytescan.chunks(column):
            start, end, first = bytescan.words(data, off)
            found += [h for h in bytescan.word_hashes(data, start, end).tolist()]
            assert first[-1] == len(start)
    assert found[1:4] == found[4:]
