import glob
import io
import os
import random
import stat

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from keystrata.functions import blake3 as B
from keystrata.functions import cbor as X
from keystrata.functions import chunking as C
from keystrata.functions import gitobj as O
from keystrata.functions import ignore as I
from keystrata.functions import keys as K
from keystrata.functions import records as R
from keystrata.functions import render as D
from keystrata.operators import build, commits, gc, graph, refs, store
from keystrata.plans import catalog


def norm(v):
    return round(v, 9) if isinstance(v, float) else str(v)[:19] if hasattr(v, "year") else str(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df = catalog.queries()[name](spark, sf)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(norm(v) for v in r) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr) == want


def test_entry_and_registry(spark):
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_blake3_known_answers():
    assert B.digest(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert B.digest(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert B.object_key(0, 0, b"").hex().endswith("13af0000")


def test_blake3_against_the_jvm(spark):
    jvm = spark.sparkContext._jvm
    r = random.Random(1)
    for n in (1, 63, 64, 65, 1023, 1024, 1025, 2048, 3000, 5000, 17000, 70001):
        data = r.randbytes(n)
        assert B.digest(data) == bytes(x & 255 for x in jvm.org.apache.commons.codec.digest.Blake3.hash(data))
        assert R.crc32c(data) == _crc(jvm, data)


def _crc(jvm, data):
    c = jvm.java.util.zip.CRC32C()
    c.update(data)
    return c.getValue()


def test_blake3_of_many(spark):
    r = random.Random(4)
    many = [r.randbytes(r.choice([0, 1, 64, 255, 256, 257, 1024, 1025, 3000, 9000])) for _ in range(60)]
    assert B.digests(many) == [B.digests([x])[0] for x in many] == [B.digest(x) for x in many]
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*many, None])], "i int, b binary")
    got = {x.i: (x.h, x.k) for x in df.select("i", B.blake3("b").alias("h"), B.blob_key("b").alias("k")).collect()}
    assert all((bytes(got[k][0]), bytes(got[k][1])) == (B.digest(x), B.object_key(0, len(x), x)) for k, x in enumerate(many)) and got[60] == (None, None)


def slow_cut(data, least, normal, most):
    n = len(data)
    if n <= least:
        return n
    if n >= most:
        n = most
    elif n <= normal:
        normal = n
    if n < least + 8:
        return n
    window, equal = data[least : least + 8], 0
    dist = sum((b ^ 0xAA).bit_count() for b in window)
    for i in range(least + 8, n - 7, 8):
        if data[i : i + 8] == window:
            equal += 1
            if equal >= 64:
                return i + 8
            continue
        equal = 0
        for j in range(8):
            if dist & (0x2C if i >= normal else 0x2F) == 0:
                return i + j
            dist += (data[i + j] ^ 0xAA).bit_count() - (data[i + j - 8] ^ 0xAA).bit_count()
        window = data[i : i + 8]
    return n


def test_chunking_against_byte_loop():
    r = random.Random(2)
    for _ in range(150):
        data = b"".join(r.choice([r.randbytes(r.randrange(900)), bytes([r.randrange(256)]) * r.randrange(1500), b"\xaa" * 40]) for _ in range(r.randrange(8)))
        least, normal, most = r.choice([(64, 128, 300), (64, 500, 2000), (70, 200, 900)])
        at, want = 0, []
        while at < len(data):
            want.append(slow_cut(data[at : at + most], least, normal, most))
            at += want[-1]
        assert C.split_bytes(data, least, normal, most) == want
    with pytest.raises(ValueError, match="normal"):
        C.split_bytes(b"x", 64, 63, 100)


def test_key_expressions_agree_with_python(spark):
    r = random.Random(3)
    rows = [(k, n, bytes(r.randbytes(32))) for k in range(6) for n in (0, 1, 255, 256, 70000, (1 << 63) - 1)]
    df = spark.createDataFrame(rows, "kind int, n long, h binary").withColumn("key", K.key_from_hash(F.col("kind"), F.col("n"), F.col("h")))
    k = F.col("key")
    for x in df.select("kind", "n", "h", "key", K.key_type(k).alias("t"), K.key_length(k).alias("l"), K.key_error(k).alias("e"), K.key_hash(k).alias("d")).collect():
        assert bytes(x.key) == B.make_key(x.kind, x.n, bytes(x.h)) and (x.t, int(x.l), x.e) == (x.kind, x.n, None)
        assert bytes(x.h).startswith(bytes(x.d))
    good = B.object_key(0, 300, b"x" * 300)
    bad = [good, good[:31], good[:31] + b"\x09", good[:31] + b"\x70", good[:29] + b"\x05\x00\x01", O.git_key_of(b"blob 0\0"), b"a" * 20 + b"b" + bytes(10) + b"\x60"]
    got = spark.createDataFrame([(b,) for b in bad], "key binary").select(K.key_error(F.col("key")).alias("e")).collect()
    assert [x.e for x in got] == [R.key_fault(b) for b in bad] == [None, "bad key length", "reserved bit set", "reserved type", "non-canonical length", None, "non-canonical git key"]


def test_rendering(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    cases = {0: "0 B", 1023: "1023 B", 1024: "1.0 KiB", 1536: "1.5 KiB", 1048575: "1.0 MiB", 5 << 30: "5.0 GiB"}
    assert {n: one(D.human_bytes(F.lit(n).cast("long"))) for n in cases} == cases
    for text, ns in {"1h30m": 5400 * 10**9, "-2.5s": -2500 * 10**6, "0": 0, "100ms": 10**8, "3x": None, "": None, "1us2ns": 1002}.items():
        assert one(D.parse_duration(F.lit(text))) == ns, text
    t = one(D.parse_rfc3339(F.lit("1969-12-31T23:59:59.5+01:30")))
    assert (t.ns, t.tz_minutes) == (-5401 * 10**9 + 5 * 10**8, 90)
    assert one(D.parse_rfc3339(F.lit("yesterday"))) is None
    assert one(D.rfc3339_utc(F.lit(-1).cast("long"))) == "1969-12-31T23:59:59Z"
    who = one(D.parse_identity(F.lit("A B <a@b.c>")))
    assert (who.name, who.email) == ("A B", "a@b.c")


def test_cbor_and_commits(spark):
    tree, parent = B.make_key(2, 5, B.digest(b"t")), B.make_key(5, 9, B.digest(b"p"))
    who = {"name": "A", "email": "a@b", "when": -5, "tz_offset": -90}
    c = {"tree": tree, "parents": [parent], "author": who, "committer": who, "message": "hello", "signature": b"s", "change_id": b"\x01", "public_key": None, "conflict_terms": None, "conflict_labels": None}
    key, data = commits.commit_object(c)
    assert X.decode_commit(data) == c and B.length_of(key) == len(data) + 5 and R.verify_object(key, data) is None
    assert X.decode_commit(X.commit_payload(c))["signature"] is None
    with pytest.raises(ValueError):
        X.encode_commit({**c, "parents": [parent, parent]})
    with pytest.raises(ValueError):
        X.load_strict(b"\x18\x05")
    assert X.load(b"\x18\x05") == 5 and X.dump([{b"b": b"", b"a": b"x"}, -300, "é"]) == bytes.fromhex("83a2416141784162403901 2b62c3a9".replace(" ", ""))
    rows = commits.decode_commits(spark.createDataFrame([(key, data), (tree, b"\xff")], "key binary, data binary"))
    got = {bytes(x.key): x for x in rows.collect()}
    assert got[key].message == "hello" and got[key].error is None and got[tree].error
    text = commits.render_commit(rows.filter("error is null")).first().text
    assert "A <a@b> 1969-12-31T22:29:59-01:30" in text
    r = {"name": "r", "key": tree, "user": "", "created_at_ns": 7, "signature": None, "public_key": None}
    assert X.decode_reference(X.encode_reference(r)) == r


def test_git_links():
    blob, sub = O.git_key_of(O.frame("blob", b"hello\n")), bytes(range(20))
    assert blob.hex() == "ce013625030ba8dba906f756967f9e9ca394464a000000000000000000000060"
    t = O.frame("tree", b"100644 f\0" + blob[:20] + b"40000 d\0" + sub + b"160000 m\0" + sub)
    assert O.links(t) == [(blob, True), (O.sha1_key(sub), False)]
    c = O.frame("commit", b"tree " + sub.hex().encode() + b"\nparent " + blob[:20].hex().encode() + b"\nauthor x\n\nparent not\n")
    assert O.links(c) == [(O.sha1_key(sub), False), (blob, False)]
    assert O.links(O.frame("tag", b"object " + sub.hex().encode() + b"\ntype blob\ntag x\n")) == [(O.sha1_key(sub), True)]
    for bad in (b"", b"blob 01\0x", b"blob 2\0x", b"tree 3\0abc"):
        with pytest.raises(ValueError):
            O.links(bad)


def test_ignore_rules(spark):
    I_rules = I.parse_file("# c\n\n*.log\n!keep.log\n/build/\ndocs/**/x?\n[a-c]z\n[\nnode/\n!node/in.js", "") + I.parse_file("*.tmp", "sub", 50)
    want = {
        ("a.log", False): True, ("keep.log", False): False, ("build", True): True, ("build", False): False, ("build/o", False): True, ("x/build", True): False, ("docs/a/b/x1", False): True,
        ("docs/x1", False): True, ("docs/x12", False): False, ("bz", False): True, ("dz", False): False, ("sub/q.tmp", False): True, ("q.tmp", False): False, ("node/in.js", False): True,
        (I.RULES_FILE, False): False, ("n.log/" + I.RULES_FILE, False): True, ("[", False): False,
    }
    assert {k: I.ignored(I_rules, *k) for k in want} == want
    df = I.mark_ignored(spark.createDataFrame(list(want), "path string, is_dir boolean"), I_rules)
    assert {(x.path, x.is_dir): x.ignored for x in df.collect()} == want


def test_records_and_packs(spark, tmp_path):
    from keystrata.sources.packs import register

    register(spark)
    rows = [(B.object_key(0, len(d), d), d) for d in (b"", b"x", b"a" * 5000, bytes(range(256)) * 9)]
    df = spark.createDataFrame(rows, "key binary, data binary").coalesce(2)
    df.write.format("kpack").option("compression", "zstd").mode("append").save(str(tmp_path / "p"))
    got = spark.read.format("kpack").load(str(tmp_path / "p"))
    assert {(bytes(x.key), bytes(x.data)) for x in got.collect()} == set(rows) and got.filter("slen < ulen").count() == 2
    assert R.unpack_lz4(bytes([0x1F]) + b"a" + b"\x01\x00" + bytes([255, 10]) + bytes([0x50]) + b"bcdef", 290) == b"a" * 285 + b"bcdef"
    rec = R.encode_record(*rows[1])
    for k in range(len(rec)):
        with pytest.raises(ValueError):
            R.parse_record(rec[:k] + bytes([rec[k] ^ 1]) + rec[k + 1 :])
    broken = b"".join(R.write_pack([rec, rec[:-1]]))
    assert [x["error"] for x in R.read_pack(broken)][0] is None and list(R.read_pack(broken))[-1]["error"]
    assert R.verify_object(rows[1][0], b"y") == "hash differs"


def test_tree_source_tar_and_build(spark, tmp_path):
    from keystrata.sources import packs, tar

    src = tmp_path / "src"
    (src / "sub" / "deep").mkdir(parents=True)
    (src / "a.txt").write_bytes(b"hello")
    (src / "sub" / "b.txt").write_bytes(b"x" * 3000)
    (src / "empty").write_bytes(b"")
    os.symlink("a.txt", src / "link")
    os.utime(src / "a.txt", ns=(1_500_000_000_123_456_789, 1_500_000_000_123_456_789))
    packs.register(spark)
    rows = spark.read.format("ktree").load(str(src))
    assert {x.path for x in rows.collect()} == {"a.txt", "empty", "link", "sub", "sub/b.txt", "sub/deep"}
    assert spark.read.format("ktree").option("exclude", "sub").option("content", "false").load(str(src)).agg(F.sum("size")).first()[0] == 5
    out = io.BytesIO()
    assert tar.export(rows, out) == 6
    out.seek(0)
    assert tar.extract(out, str(tmp_path / "dst")) == 6
    assert (tmp_path / "dst/sub/b.txt").read_bytes() == b"x" * 3000 and os.readlink(tmp_path / "dst/link") == "a.txt"
    assert os.stat(tmp_path / "dst/a.txt").st_mtime_ns == 1_500_000_000_123_456_789
    with pytest.raises(ValueError):
        tar.safe_join(str(tmp_path), "a/../../x")
    files = rows.filter(F.col("mode").bitwiseAND(stat.S_IFREG) == stat.S_IFREG).filter("data is not null").select("path", "data", "mode", "mtime_ns")
    objects, root = build.tree_objects(files)
    root_key = bytes(root.first().key)
    again = bytes(build.tree_objects(files.repartition(3))[1].first().key)
    assert root_key == again and root_key[31] >> 4 == 2
    stored = {bytes(x.key): bytes(x.data) for x in objects.collect()}
    assert all(R.verify_object(k, d) is None for k, d in stored.items())
    names = [e["name"] for e in X.decode_dir_leaf(stored[root_key])]
    assert names == [b"a.txt", b"empty", b"sub"]
    reach = graph.closure(build.edges(objects), root)
    assert {bytes(x.key) for x in reach.collect()} == set(stored)


def test_wide_directory_gets_index_levels():
    entries = [{"name": f"e{k:06}".encode(), "mode": 0o100644, "uid": 0, "gid": 0, "mtime_ns": k, "content_key": B.object_key(0, 0, b"")} for k in range(3000)]
    made = build.build_dir(entries)
    stored = {k: d for k, _, d in made}
    root = made[-1][0]
    assert root[31] >> 4 == 3

    def names(k):
        return [e["name"] for e in X.decode_dir_leaf(stored[k])] if k[31] >> 4 == 2 else [n for _, c in X.decode_dir_node(stored[k]) for n in names(c)]

    assert names(root) == [e["name"] for e in entries]
    assert build.build_file(b"")[-1][0] == B.object_key(0, 0, b"")


def test_graph_on_cycles_and_deep_chains(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    a = spark.createDataFrame([("a",)], "key string")
    assert {x.key for x in graph.reachable_keys(e, a).collect()} == {"a", "b", "c"}
    chain = spark.range(60).selectExpr("concat('n', id) as parent", "concat('n', id + 1) as child")
    got = graph.closure(chain, spark.createDataFrame([("n0",)], "key string"), most_rounds=3)
    assert {(x.key, x.depth) for x in got.collect()} == {(f"n{k}", k) for k in range(61)}


def test_cycle_and_budget(spark):
    index = spark.createDataFrame([(s, f"k{s}-{i}", i, 54) for s in range(4) for i in range(4)], "seg_id long, key string, off long, slen long").withColumn("sealed_at", F.to_timestamp(F.lit("2020-01-01")))
    edges = spark.createDataFrame([("r", f"k{s}-{i}") for s in range(4) for i in range(s)], "parent string, child string")
    refs_ = spark.createDataFrame([("main", "r")], "name string, key string")
    after, stats = gc.cycle(index, edges, refs_, F.to_timestamp(F.lit("2021-01-01")), 0.5, None)
    assert (stats.packs, stats.reaped, stats.copied_bytes, stats.freed_bytes) == (4, 3, 300, 900)
    assert after.count() == 4 + 3
    scores = gc.liveness(index, spark.createDataFrame([(f"k{s}-{i}",) for s in range(4) for i in range(s)], "key string"))
    taken = {x.seg_id: x.taken for x in gc.select_victims(scores, None, 0.0, 350).collect()}
    assert taken == {0: True, 1: True, 2: True, 3: False}
    skipped = spark.createDataFrame([(1,)], "seg_id long")
    assert {x.seg_id for x in gc.select_victims(scores, None, 0.0, 300, skipped).filter("taken").collect()} == {0, 2, 1}
    grey = spark.createDataFrame([("k0-0",)], "key string")
    assert gc.cycle(index, edges, refs_, None, 0.5, 0, grey)[1].reaped == 0
    assert gc.garbage_line(0.3, "/") == 0.3 and gc.garbage_line(-1, "/") in (0.5, 0.1)


def test_reference_table(spark, tmp_path):
    t = refs.RefTable(spark, str(tmp_path / "refs"))
    t.create("a", "k1")
    t.put("b", "k2")
    with pytest.raises(refs.Conflict):
        t.create("a", "k9")
    with pytest.raises(refs.Conflict):
        t.compare_and_swap("a", "k0", "k3")
    t.compare_and_swap("a", "k1", "k3")
    with pytest.raises(refs.NotFound):
        t.get("zz")
    records = spark.createDataFrame([("a", "k4", "", 0, "k3"), ("c", "k5", "", 0, None)], "name string, key string, user string, created_at_ns long, old string")
    gone = spark.createDataFrame([("b", "k2"), ("q", "k7")], "name string, old string")
    with pytest.raises(refs.Conflict):
        t.update_batch(records.withColumn("old", F.lit("zz")), gone)
    assert t.get("a") == "k3"
    assert t.update_batch(records, gone) == 1
    assert {(x.name, x.key) for x in t.all().collect()} == {("a", "k4"), ("c", "k5")}
    t.compare_and_delete("c", "k5")
    t.wipe()
    assert t.all().count() == 0


def test_store_write_and_verify(spark, tmp_path):
    rows = [(B.object_key(0, 1, d), d, k, 1) for k, d in enumerate([b"a", b"b", b"a"])]
    batch = spark.createDataFrame(rows, "key binary, data binary, pos long, size long")
    s = store.write_batch(batch, str(tmp_path / "o"), 1).first()
    assert (s.stored, s.deduped, s.bytes_stored) == (2, 1, 2)
    stored = spark.read.parquet(str(tmp_path / "o"))
    s = store.write_batch(batch, str(tmp_path / "o"), 2, stored).first()
    assert (s.stored, s.deduped) == (0, 3)


def test_inbox(spark, tmp_path):
    from keystrata.streaming.inbox import Inbox

    inbox = Inbox(spark, str(tmp_path / "in"))
    pack = lambda *data: b"".join(R.write_pack(R.encode_record(B.object_key(0, len(d), d), d) for d in data))
    assert inbox.commit(*inbox.stage("r1", pack(b"one", b"two")))
    assert not inbox.commit(*inbox.stage("r1", pack(b"one", b"two")))
    assert inbox.commit(*inbox.stage("r2", pack(b"two", b"three")))
    assert inbox.commit(*inbox.stage("r2", b"".join(R.write_pack([R.encode_record(B.object_key(0, 3, b"bad"), b"not")]))))
    assert (inbox.pending("r1"), inbox.pending("r2")) == (1, 2)
    inbox.process()
    assert inbox.pending("r2") == 0 and inbox.failed().count() == 1
    assert {(x.root, x.n) for x in inbox.accepted().collect()} == {("r1", 2), ("r2", 2)}
    assert sorted(bytes(x.data) for x in inbox._objects().collect()) == [b"one", b"three", b"two"]
    inbox.commit(*inbox.stage("r3", pack(b"four", b"one")))
    inbox.process()
    assert inbox._objects().count() == 4


def test_native_queries(spark, sf):
    q = E.queries()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert {(x.doc_id, x.key) for x in q["blob_keys"](spark, sf).collect()} == {(x.doc_id, B.object_key(0, len(b := x.text.encode()), b).hex()) for x in docs}
    one = q["byte_chunks"](spark, sf).first()
    assert one.logical_bytes == sum(len(x.text.encode()) for x in docs) and one.unique_bytes < one.logical_bytes
    kinds = {x.type: x for x in q["tree_build"](spark, sf).collect()}
    n = sum(x.n for t, x in kinds.items() if t >= 0)
    assert sum(x.n for x in q["tree_closure"](spark, sf).collect()) == n and len(kinds[-1].root) == 64
    rules = I.parse_file("*.html\n!/en/4*.html\n/fr/\n**/8?\n[1-3]*", "")
    assert all(x.ignored == I.ignored(rules, x.path, False) for x in q["ignored_paths"](spark, sf).collect())


def test_compaction_trusts_only_verified_records(spark):
    rows = [(0, "a", 10, False), (1, "a", 10, True), (1, "b", 10, True), (2, "c", 10, False), (2, "d", 10, True), (3, "c", 10, True), (3, "x", 10, False), (4, "e", 10, True), (4, "f", 10, False), (0, "f", 10, True)]
    index = spark.createDataFrame(rows, "seg_id long, key string, slen long, ok boolean").withColumn("sealed_at", F.to_timestamp(F.lit("2020-01-01")))
    live = spark.createDataFrame([(k,) for k in "abcdef"], "key string")
    victims = spark.createDataFrame([(1, True), (2, True), (3, True), (4, True), (0, False)], "seg_id long, taken boolean")
    assert {x.seg_id for x in gc.left_in_place(index, live, victims, F.col("ok")).collect()} == {2}
    got = sorted((x.seg_id, x.key) for x in gc.compact(index, live, victims, 100, F.col("ok")).collect())
    # a: its survivor in 0 is bad; c: bad in 2, which stays, and good in 3; f: bad in 4, its survivor is good; x is dead
    assert got == [(0, "a"), (0, "f"), (2, "c"), (2, "d"), (100, "a"), (100, "b"), (100, "c"), (100, "e")]
    edges = spark.createDataFrame([("r", k) for k in "abcdef"], "parent string, child string")
    after, stats = gc.cycle(index, edges, spark.createDataFrame([("main", "r")], "name string, key string"), None, 0.0, None, good=F.col("ok"))
    assert {"a", "b", "c", "d", "e", "f"} <= {x.key for x in after.collect()} and stats.reaped < stats.packs


def test_scrub_finds_bad_records(spark):
    datas = [b"one", b"two" * 50, b"three", b"four"]
    keys = [B.object_key(0, len(d), d) for d in datas]
    recs = [R.encode_record(k, d, "zstd") for k, d in zip(keys, datas)]
    recs[0] = recs[0][:-1] + b"x"  # checksum
    recs[2] = R.encode_record(keys[2], b"other")  # sound record of other bytes
    rows = [(k % 2, 100 * k, r) for k, r in enumerate(recs)] + [(1, 900, None)]
    records = spark.createDataFrame([(s, o, None if r is None else bytearray(r)) for s, o, r in rows], "seg_id long, off long, record binary")
    index = spark.createDataFrame([(0, bytearray(keys[0]), 0), (1, bytearray(keys[1]), 100), (0, bytearray(keys[2]), 200), (1, bytearray(keys[3]), 333)], "seg_id long, key binary, off long")
    got = {(x.seg_id, x.off, x.fault) for x in gc.scrub(records, index).collect()}
    assert got == {(0, 0, "bad checksum"), (0, 0, "no record"), (0, 200, "hash differs"), (1, 900, "short record"), (1, 300, "not indexed"), (1, 333, "no record")}


def test_of_two_writers_one_conflicts_and_changes_nothing(spark, tmp_path):
    from keystrata.operators import refs

    a, b = refs.RefTable(spark, f"{tmp_path}/refs"), refs.RefTable(spark, f"{tmp_path}/refs")
    a.put("x", "first")
    v, stale = b.version(), b.all()
    a.put("x", "from a")
    with pytest.raises(refs.Conflict):
        b._publish(refs.upsert(stale, b._row("x", "from b", "", 0)), v)
    assert a.get("x") == b.get("x") == "from a" and a.version() == 2
    assert sum(n.startswith("rows-") for n in os.listdir(f"{tmp_path}/refs")) == 2
    with pytest.raises(refs.Conflict):
        b.compare_and_swap("x", "first", "late")
    b.compare_and_swap("x", "from a", "swapped")
    with pytest.raises(refs.Conflict):
        a.create("x", "k")
    a.create("y", "k")
    with pytest.raises(refs.Conflict):
        a.compare_and_delete("y", "other")
    a.delete("y")
    with pytest.raises(refs.NotFound):
        b.get("y")
    assert a.get("x") == "swapped"


def test_many_victims_under_a_budget(spark):
    from keystrata.operators import gc

    r = random.Random(5)
    packs = [(k, r.randrange(1000), r.randrange(1, 1000)) for k in range(20_000)]
    scores = spark.createDataFrame(packs, "seg_id long, live_bytes long, dead_bytes long").withColumns({"dead_keys": F.lit(1), "sealed_at": F.lit(0)})
    skipped = spark.createDataFrame([(k,) for k in range(0, 20_000, 3)], "seg_id long")
    left, want = 1_000_000, set()
    for k, live, dead in sorted((p for p in packs if p[2] >= 0.5 * (p[1] + p[2])), key=lambda p: (p[0] % 3 == 0, p[0])):
        if live <= left:
            left -= live
            want.add(k)
    got = gc.select_victims(scores, None, 0.5, 1_000_000, skipped).filter("taken").collect()
    assert {x.seg_id for x in got} == want


def test_deep_and_wide_walks(spark):
    from keystrata.operators import graph

    chain = [(k, k + 1) for k in range(700)]
    wide = [(1_000_000, 1_000_001 + k) for k in range(500)] + [(1_000_001 + k, 2_000_000) for k in range(500)] + [(2_000_000, 1_000_000)]
    edges = spark.createDataFrame(chain + wide, "parent long, child long")
    got = {x.key: x.depth for x in graph.closure(edges, spark.createDataFrame([(0,)], "key long"), most_rounds=7).collect()}
    assert got == {k: k for k in range(701)}
    got = {x.key: x.depth for x in graph.closure(edges, spark.createDataFrame([(1_000_000,)], "key long")).collect()}
    assert got == {1_000_000: 0, 2_000_000: 2} | {1_000_001 + k: 1 for k in range(500)}


def shuffled_records(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_a_walk_shuffles_its_edges_once(spark):
    chain = spark.range(12).selectExpr("id as parent", "id + 1 as child")
    edges = chain.unionByName(chain).unionByName(spark.range(1000, 31_000).selectExpr("id as parent", "-id as child"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_records(spark)
        got = {x.key: x.depth for x in graph.closure(edges, spark.createDataFrame([(0,)], "key long")).collect()}
        assert got == {k: k for k in range(13)}
        assert shuffled_records(spark) - before < 2 * 30_024
        # repeated edges in a chain that is finished by doubling
        got = {x.key: x.depth for x in graph.closure(edges, spark.createDataFrame([(0,)], "key long"), most_rounds=3).collect()}
        assert got == {k: k for k in range(13)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0


def test_chunks_leave_in_small_batches():
    import pyarrow as pa

    r = random.Random(9)
    files = [b"", None, b"a" * 70, r.randbytes(300_000), r.randbytes(5000), b"\xaa" * 90_000]
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{k}" for k in range(6)]), pa.array(files, pa.binary())], ["file_id", "data"]).slice(1)
    out = list(C.cut_batches(256, 1024, 4096, 20_000)(iter([batch])))
    assert len(out) > 10 and max(sum(b.column("length").to_pylist()) for b in out) < 20_000 + 4096
    got = [tuple(x.values()) for b in out for x in b.to_pylist()]
    want = []
    for k, data in enumerate(files):
        at = 0
        for n, size in enumerate(C.split_bytes(data or b"", 256, 1024, 4096)):
            want.append((f"f{k}", n, at, size, data[at : at + size]))
            at += size
    assert got == want


def test_edges_to_leaves_are_read_once_and_not_shuffled_for_few_parents(spark):
    inner = spark.range(6).selectExpr("concat('a', id) as parent", "concat('a', id + 1) as child", "false as leaf")
    edges = inner.unionByName(spark.range(30_000).selectExpr("concat('a', id % 6) as parent", "concat('l', id % 10) as child", "true as leaf"))
    roots, refs = spark.sql("select 'a2' as key"), spark.sql("select concat('r', id) as name, concat('a', id) as key from range(7)")
    before = shuffled_records(spark)
    want = {f"a{k}": k - 2 for k in range(2, 7)} | {f"l{k}": 1 + k % 2 for k in range(10)}  # even parents have the even leaves
    assert {x.key: x.depth for x in graph.closure(edges, roots).collect()} == want
    assert [x.name for x in graph.why(edges, refs, spark.sql("select 'l3' as key")).collect()] == ["r0", "r1", "r2", "r3", "r4", "r5"]
    assert {x.key for x in graph.reaches(edges, refs, spark.sql("select 'a3' as key")).collect()} == {"a0", "a1", "a2", "a3"}
    assert shuffled_records(spark) - before < 2000
    parts = [graph._found(spark.sql("select concat('a', id) as key, id as depth from range(4)"))]
    ways = [graph._leave(parts, edges.select("parent", "child"), *limits) for limits in ((8 << 20,), (0, 64 << 20), (0, 0))]
    assert len({str(sorted(map(tuple, way.select("parent", "child", "depth").collect()))) for way in ways}) == 1 and ways[2].count() == 20_004


def test_a_leaf_found_on_two_ways_keeps_its_lesser_depth(spark):
    rows = [("r", "a", False), ("a", "b", None), ("b", "x", False), ("r", "x", True), ("b", "y", True), ("b", None, True)]
    edges = spark.createDataFrame(rows, "parent string, child string, leaf boolean")
    got = graph.closure(edges, spark.sql("select 'r' as key")).collect()
    assert sorted(map(tuple, got), key=str) == [("a", 1), ("b", 2), ("r", 0), ("x", 1), ("y", 3), (None, 3)]


def test_rounds_that_lie_apart_are_not_compared(spark):
    edges = spark.range(9000).selectExpr("concat(substring('abc', cast(id % 3 as int) + 1, 1), id div 3) as parent", "concat(substring('bcd', cast(id % 3 as int) + 1, 1), id div 3) as child")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_records(spark)
        got = graph.closure(edges, spark.range(3000).selectExpr("concat('a', id) as key")).groupBy("depth").count().collect()
        assert {x["depth"]: x["count"] for x in got} == {k: 3000 for k in range(4)}
        assert shuffled_records(spark) - before < 40_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_walks_over_keys_of_any_bytes(spark):
    r = random.Random(11)
    keys = [bytes(r.choice(b"\x00a\x7f\x80\xc3\xbf\xef\xff") for _ in range(r.randrange(4))).hex() for _ in range(150)]
    links = [(r.choice(keys), r.choice(keys)) for _ in range(190)]
    seen, at, depth = {keys[0]: 0}, {keys[0]}, 0
    while at:
        depth += 1
        at = {b for a, b in links if a in at} - seen.keys()
        seen |= dict.fromkeys(at, depth)
    pairs = spark.createDataFrame(links, "a string, b string")
    for cast in ("string", "binary"):
        edges = pairs.select(F.unhex("a").cast(cast).alias("parent"), F.unhex("b").cast(cast).alias("child"))
        got = graph.closure(edges, spark.sql(f"select cast(unhex('{keys[0]}') as {cast}) as key")).selectExpr("lower(hex(key)) as key", "depth").collect()
        assert sorted(map(tuple, got)) == sorted(seen.items())


def test_lacking_keys_are_found_once(spark):
    edges = spark.range(50).selectExpr("concat('a', id) as parent", "concat('b', id % 7) as child", "true as leaf")
    roots, stored = spark.sql("select concat('a', id) as key from range(4)"), spark.sql("select inline(array(struct('a1' as key), struct('b2' as key)))")
    got = graph.incomplete(edges, roots, stored)
    assert [tuple(x) for x in got.collect()] == [("a0", 0), ("a2", 0), ("a3", 0), ("b0", 1), ("b1", 1), ("b3", 1)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_edges_of_numbered_parents_are_not_shuffled(spark):
    parents = ["concat('o', id)", "concat('ob', id * 3)", "concat('o1b', id)", "cast(id as string)", "concat('o', id + 9000000000)"]
    found = spark.sql(" union all ".join(f"select {p} as key, id % 3 as depth from range(40000)" for p in parents)).distinct()
    extra = ["o", "o01", "o007", "o+5", "o 5", "o5 ", "o-5", "o5.0", "p5", "ob1", "ob3", "o1b", "o1b2", "00", "0", "99999999999999999999999", "o99999999999999999999999", "", "é 5"]
    edges = spark.range(60_000).selectExpr("concat('o', id * 2) as parent", "concat('l', id % 10) as child")
    edges = edges.unionByName(spark.createDataFrame([(x, "x" + x) for x in extra] + [(None, "none")], "parent string, child string"))
    part = graph._found(found)
    assert part.size > 8 << 20 and part.prefixes() == {"", "ob"}
    want = sorted(map(tuple, graph._leave([part], edges, 0, 64 << 20, 0).select("parent", "depth", "child").collect()))
    before = shuffled_records(spark)
    rows, prefixes = part.rows.withColumnRenamed("key", "parent"), {"", "o", "ob", "o1b"}
    leaving = graph._leave_numbered(rows, edges, prefixes, 32 << 20)
    assert sorted(map(tuple, leaving.collect())) == want and len(want) == 20_003
    assert shuffled_records(spark) - before < 40_000  # words of the bitmaps
    # keys that are no number, or too thin for bitmaps: not taken, and the same rows come by a shuffle
    assert graph._leave_numbered(rows, edges, prefixes, 1000) is None
    for odd in ("o01", "é5"):
        more = rows.unionByName(spark.sql(f"select '{odd}' as parent, 0L as depth"))
        assert graph._leave_numbered(more, edges, prefixes, 32 << 20) is None
    assert graph._leave_numbered(rows, edges, {"", "ob"}, 32 << 20) is None
    assert sorted(map(tuple, graph._leave([part], edges).select("parent", "depth", "child").collect())) == want


def test_a_frontier_apart_from_all_parents_is_not_shuffled(spark):
    edges = spark.range(20_000).selectExpr("concat('a', id % 5) as parent", "concat('b', id) as child", "false as leaf")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_records(spark)
        assert graph.reachable_keys(edges, spark.sql("select concat('a', id) as key from range(5)")).count() == 20_005
        assert shuffled_records(spark) - before < 50_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_numbered_keys_are_kept_as_words(spark):
    odd = ["p1\n", "p01", "p0", "p", "", "12", "p-5", " 5", "p5 ", "p999999999999999999", "p9999999999999999999", "p63", "é7", "a1b2", "o1", "o10", "o99", "o100", "o127", None]
    part = graph._found(spark.createDataFrame([(x, d) for x in odd for d in (1, 2)], "key string, depth long"))
    assert sorted(map(repr, map(tuple, part.rows.collect()))) == sorted(repr((x, d)) for x in odd for d in (1, 2))
    assert part.n == 2 * len(odd) and (part.least, part.most) == (b"", "é7".encode())
    for low, high in ((1000, 1100), (95, 105), (0, 7), (63, 64)):
        part = graph._found(spark.range(low, high).selectExpr("concat('o', id) as key", "0L as depth"))
        keys = sorted(f"o{k}".encode() for k in range(low, high))
        assert part.n == len(keys) and part.least <= keys[0] and part.most >= keys[-1] and part.rows.count() == len(keys)
        assert not graph._found(spark.sql("select 'o' as key, 0L as depth")).meets(part) and graph._found(spark.sql(f"select 'o{low}' as key, 0L as depth")).meets(part)
    part = graph._found(spark.range(100_000).selectExpr("concat('o', id) as key", "3L as depth"))
    assert part.n == 100_000 and part.words.count() == 1563
    assert part.rows.distinct().agg(F.count("key"), F.sum(F.substring("key", 2, 9).cast("long"))).first() == (100_000, 99_999 * 50_000)


def test_walks_over_numbered_keys_shuffle_words(spark):
    inner = spark.range(100_000).selectExpr("concat('c', id div 100) as parent", "concat('o', id) as child", "false as leaf")
    leaves = spark.range(100_000).selectExpr("concat('o', id) as parent", "concat('p', id) as child", "true as leaf")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_records(spark)
        assert graph.reachable_keys(inner.unionByName(leaves), spark.sql("select concat('c', id) as key from range(1000)")).distinct().count() == 201_000
        assert shuffled_records(spark) - before < 201_000 + 30_000  # those of the distinct here, and words
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("most_rounds", [200, 2])
def test_walks_over_numbered_and_other_keys(spark, most_rounds):
    r = random.Random(5)
    keys = [f"{h}{k}" for h in ("a", "b1x", "", "a0") for k in range(60)]
    links = [(r.choice(keys), r.choice(keys), False) for _ in range(330)] + [(r.choice(keys), r.choice(keys) if k % 3 == 0 else f"l{k % 70}", True) for k in range(200)]
    links = [(a, b, leaf) for a, b, leaf in links if not leaf or b[0] == "l" or not any(x == b for x, _, _ in links)]
    edges = spark.createDataFrame(links, "parent string, child string, leaf boolean")

    def want(pairs, starts):
        seen, at, depth = dict.fromkeys(starts, 0), set(starts), 0
        while at:
            depth += 1
            at = {b for a, b in pairs if a in at} - seen.keys()
            seen |= dict.fromkeys(at, depth)
        return sorted(seen.items())

    starts = r.sample(keys, 4)
    got = graph.closure(edges, spark.createDataFrame([(x,) for x in starts], "key string"), most_rounds)
    assert sorted(map(tuple, got.collect())) == want([x[:2] for x in links], starts)
    ends = ["l3", "l9", starts[0]]
    got = graph.closure_up(edges, spark.createDataFrame([(x,) for x in ends], "key string"), most_rounds)
    assert sorted(map(tuple, got.collect())) == want([(b, a) for a, b, _ in links], ends)
