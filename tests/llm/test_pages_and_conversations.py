"""Archives and prefix tries: exact round trips and brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm import prefix_trie, warc
from lodestar.llm.scratch import Scratch

PAGES = "page_id long, url string, html string, digest string, uid int, header string"


def archive(spark, rows, tmp_path, name="a"):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES).repartition(3)
    return warc.write(df, f"file://{tmp_path}/{name}")


def test_payloads_of_many_lengths(spark, tmp_path):
    """So many in one file that the dictionary of lengths, by which payloads are filtered, is above 32 KB."""
    rows = spark.range(10000).coalesce(1).selectExpr("id AS page_id", "'u' AS url", "repeat('x', CAST(id % 5000 AS INT) + 100) AS html")
    kinds = warc.write(rows, f"file://{tmp_path}/many").read(spark).groupBy("record_type").agg(F.count(F.lit(1)), F.countDistinct("payload_digest"))
    assert sorted(map(tuple, kinds.collect())) == [("response", 5000, 5000), ("revisit", 5000, 5000)]


def test_records_come_back(spark, tmp_path):
    rng = random.Random(0)
    long = ["é<p>" * 40, "a" * 100, "b" * 99, "x\r\n\r\ny\x00" * 500, "z" * 3_000_000]
    rows = [(i, f"http://h/{i}\r\nX-Page-Id: 9" if i % 9 == 0 else f"http://h/{i}", rng.choice([*long, f"own {i} " * 30, "", None])) for i in range(120)]
    rows += [(None, None, "n" * 200), (None, None, "n" * 200), (7, "u", "twin" * 50), (7, "u", "twin" * 50), (None, None, "twin" * 50), (200, None, None)]
    a = archive(spark, rows, tmp_path)
    got = a.read(spark).collect()
    bytes_ = lambda t: (t or "").encode()
    assert sorted((r.page_id is None, r.page_id or 0, bytes(r.payload)) for r in got) == sorted((i is None, i or 0, bytes_(t)) for i, _, t in rows)
    groups = {}
    for i, _, t in rows:
        groups.setdefault(bytes_(t), []).append(i)
    for r in got:
        ids, payload = groups[bytes(r.payload)], bytes(r.payload)
        assert r.payload_digest == hashlib.sha256(payload).hexdigest() and r.payload_bytes == len(payload)
        if len(payload) < 100:
            assert (r.record_type, r.refers_to) == ("response", None)
        else:
            known = [i for i in ids if i is not None]
            assert r.refers_to == (min(known, default=None) if r.record_type == "revisit" else None)
            assert r.record_type == "revisit" or r.page_id == min(known, default=None)
        head, rest = bytes(r.record).split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.decode() + "\r\n" == r.header and rest[-4:] == b"\r\n\r\n" and int(fields["Content-Length"]) == len(rest) - 4
        assert rest[:-4] == warc.HTTP_HEAD.encode() + (payload if r.record_type == "response" else b"")
        assert fields["WARC-Payload-Digest"] == f"sha256:{r.payload_digest}"
    for payload, ids in groups.items():
        types = [r.record_type for r in got if bytes(r.payload) == payload]
        assert types.count("response") == (1 if len(payload) >= 100 else len(ids))
    by_id = {r.record_id: r for r in got}
    assert len(by_id) == len(got)
    assert all(by_id[r.refers_to_id].record_type == "response" and by_id[r.refers_to_id].payload == r.payload for r in got if r.record_type == "revisit")
    assert a.payloads(spark).count() == len(groups)


def test_damaged_archives_are_errors(spark, tmp_path):
    a = archive(spark, [(1, "u", "p" * 200), (2, "u", "q" * 200)], tmp_path)
    stored = spark.read.parquet(f"{a.path}/payloads")
    stored.withColumn("payload", F.when(F.substring("payload", 1, 1) == F.lit(b"p"), F.lit(b"p" * 199 + b"x")).otherwise(F.col("payload"))).write.parquet(f"{a.path}2/payloads")
    a.headers(spark).write.parquet(f"{a.path}2/records")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.Archive(f"{a.path}2").read(spark).collect()
    stored.limit(1).write.parquet(f"{a.path}3/payloads")
    a.headers(spark).write.parquet(f"{a.path}3/records")
    with pytest.raises(Exception, match="no payload is stored"):
        warc.Archive(f"{a.path}3").read(spark).collect()
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        archive(spark, [(1, "u", "p")], tmp_path)


def test_empty_archive_and_moved_bytes(spark, tmp_path):
    a = archive(spark, [], tmp_path)
    assert a.read(spark).collect() == []
    plan = a.read(spark).select("page_id", "payload_digest")._jdf.queryExecution().optimizedPlan().toString()
    join = plan[: plan.index("Join")].count("payload#")  # nothing above the join holds bytes
    assert join == 0


def plain_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            tie = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()
            own.setdefault(c, []).append((t is not None, t or 0, tie, r, x))
    own = {c: [(r, x) for *_, r, x in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    nodes = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    kids = {p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p] for p in nodes}
    out = []
    for p, ids in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].split()) for q in under if q)
        ends = ",".join(str(c) for c in sorted(ids) if convs[c] == p)
        out.append((min(ids), len(p), min(nodes[p[:-1]]) if p else None, len(ids), len(kids[p]), sum(not kids[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 2, 5, 40, None])
def test_trie_is_the_plain_one(spark, parts):
    rng = random.Random(parts or 0)
    rows = [(c, t, rng.choice(["user", "user", None]), rng.choice(["a", "a b", "a", None, "c  d\te"])) for c in range(130) if c != 40 for t in range(rng.choice([1, 1, 2, 3, 5]))]
    rows += [(500, t, "user", "a") for t in range(60)] + [(501, t, "user", "a") for t in range(61)] + [(502, 0, "user", "a"), (502, 0, "user", "b"), (502, 0, "user", "a"), (502, None, "z", "z"), (None, 1, "user", "a")]
    rows += [(600 + i, t, "r", "same words here") for i in range(200) for t in range(4)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, id int, path string").repartition(3)
    got = prefix_trie.conversation_trie(df, parts=parts)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_trie(rows)


def test_trie_of_nothing_and_of_long_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.conversation_trie(spark.createDataFrame([], schema)).collect() == []
    rows = [(20, 0, "user", "w " * 400_000), (21, 0, "user", "w " * 400_000), (21, 1, "", "é"), (20, 1, "u", "x\x0by\u00a0z"), (22, 5, "ab", "c"), (42, 5, "a", "bc")]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, schema), parts=3).collect()
    want = [(*w[:6], w[6], w[7]) for w in plain_trie([(c, t, r, x.replace("\u00a0", "_")) for c, t, r, x in rows])]
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_ids_of_a_path_are_hashed_in_pieces(spark):
    one = F.array(F.struct(F.lit(0).alias("turn"), F.lit("0a" * prefix_trie.TURN).alias("digest"), F.lit(3).alias("words")))
    convs = spark.range(0, 5000).select("id", F.when(F.col("id") % 10 == 0, F.slice(one, 1, 0)).otherwise(one).alias("turns"))
    got = {len(r.path): r for r in prefix_trie.distinct_paths(convs, Scratch(spark), piece_bytes=10).collect()}
    for length, own in ((0, lambda i: i % 10 == 0), (prefix_trie.TURN, lambda i: i % 10)):
        ids = [i for i in range(5000) if own(i)]
        assert (got[length].n, got[length].conv_id) == (len(ids), ids[0]) and got[length].ends == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
