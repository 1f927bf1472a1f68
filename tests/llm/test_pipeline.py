"""The pipeline's stages one by one, each against what it was given, and all of them against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import langid, packing, secrets
from lodestar.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, columns, sizes = Scratch(spark), docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.save(stage(spark, docs, SF))
        assert out.columns == columns, name
        if name != "source_mixing":
            assert out.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        sizes.append(out.count())
        docs = out
    assert sizes[0] > 190
    assert sizes[1] <= sizes[0]
    assert sizes[2] == sizes[1]
    assert docs.filter(F.col("text").rlike("token = .[0-9a-f]{20}")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def kept_languages(docs, model):
    out = []
    for d in docs:
        lang, _, margin = model.predict(d["text"])
        if lang != "und" and margin >= model.min_margin:
            out.append(d)
    return out


def without_copies(docs):
    sets = {}
    for d in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or ""))
        sets[d["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [d for d in docs if root(d["doc_id"]) == d["doc_id"]]


def cleaned(docs, model):
    out = []
    for d in docs:
        text, spans = d["text"], secrets.base_spans(d["text"])[0]
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text):
            spans += [(m.start() + a, m.start() + b, "grammar") for a, b in model.credentials(m[0]) if not any(m.start() + a < y and x < m.start() + b for x, y, k in spans if k != "grammar")]
        gone = sorted({i for a, b, _ in spans for i in range(a, b)})
        chars, starts = list(text), {a for a, _, _ in spans}
        for i in gone:
            chars[i] = "[secret]" if i in starts and (i - 1 not in gone or not any(a < i < b for a, b, _ in spans)) else ""
        out.append(d | {"text": "".join(chars)})
    return out


def mixed(docs):
    size = {d["doc_id"]: len(WORD.findall(d["text"])) for d in docs}
    by_source = {}
    for d in docs:
        by_source.setdefault(d["source"], []).append(d)
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    own = {s: sum(size[d["doc_id"]] for d in by_source[s]) for s in names}
    target, free, left = {}, set(names), float(sum(own.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * own[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * own[s]
            left -= 3 * own[s]
        free -= full
    out = []
    for s in names:
        want, order = int(target[s]), sorted(by_source[s], key=lambda d: (int(hashlib.md5(str(d["doc_id"]).encode()).hexdigest()[:15], 16), d["doc_id"]))
        passes = want // own[s] if own[s] else 0
        rest = want - passes * own[s]
        for d in order:
            n = size[d["doc_id"]]
            part = max(0, min(n, rest))
            rest -= n
            out += [d] * ((passes if n else 0) + (part > 0 and 2 * part >= n))
    return out


def test_run_against_plain_python(spark, tmp_path):
    """All rows of run(), over documents with copies, secrets, nulls, empty texts and odd languages."""
    source = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(90)
    rows = [r.asDict() for r in source.collect()]
    first = max((r for r in rows if r["text"]), key=lambda r: len(r["text"]))
    words = first["text"].split()
    words[len(words) // 2] = "changed"
    extra = [(9001, first["text"]), (9002, " ".join(words)), (9003, None), (9004, ""), (9005, "12 34"), (9006, first["text"][:300] + " token = abcdef0123456789abcdef key")]
    rows += [first | {"doc_id": i, "text": t, "n_chars": len(t or ""), "source": None if i == 9006 else "late"} for i, t in extra]
    docs = spark.createDataFrame([tuple(r[c] for c in source.columns) for r in rows], source.schema)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    one = kept_languages(rows, langid.fit(read))
    assert not {9003, 9004, 9005} & {d["doc_id"] for d in one}
    two = without_copies(one)
    assert not {9001, 9002} & {d["doc_id"] for d in two}
    kept = spark.createDataFrame([tuple(r[c] for c in source.columns) for r in two], source.schema)
    three = cleaned(two, secrets.fit(kept))
    assert any("[secret]" in d["text"] for d in three)
    four = mixed(three)
    tokenizer = packing.Tokens(packing.default_tokenizer(), 1).tokenizer
    want = Counter()
    for d in four:
        ids = [*tokenizer.encode(d["text"], add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            piece = ids[a : a + 4096]
            want[d["doc_id"], k, a, len(piece), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, o, n), (t, p, _) in zip(places, places[1:], strict=False):
        assert p == (o + n if s == t else 0)
        assert o + n <= 4096


@pytest.mark.parametrize("some", ["false", "doc_id < 3"])
def test_stages_with_few_rows_and_clashing_columns(spark, some):
    """Empty tables, nulls in any column and names that stages use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (2, None, "xx", "s", None)], docs.schema)
    docs = docs.unionByName(odd).filter(f"({some}) OR (doc_id IS NULL AND {some} IS NULL)")
    docs = docs.withColumn("__language", F.lit(1)).withColumn("key", F.lit("k")).withColumn("size", F.lit(2)).withColumn("part", F.lit(3)).withColumn("take", F.lit(4))
    columns = docs.columns
    scratch = Scratch(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, SF))
        assert docs.columns == columns
    corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
