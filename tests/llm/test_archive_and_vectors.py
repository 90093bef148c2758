"""Whitening, importance resampling and the WARC archive on small hostile tables, against brute force."""

import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pyspark.sql import functions as F

from varispark.llm import importance, warc, whitening

# --- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, w string, id int").repartition(3)


def checked(got, rows, width, top=8):
    """Compares op11's rows with exact fractions and a plain eigendecomposition."""
    usable = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda c: max(min(math.floor(c), 1 << 62), -(1 << 62))
    x = [[clip(1024 * float(np.float32(c))) + 100_000 for c in v] + [100_000] * (width - len(v)) for _, v in usable]
    n, s = len(x), [sum(c) for c in zip(*x)]
    c = [[n * a - b for a, b in zip(r, s)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in c), n**3)) for j in range(width)] for i in range(width)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(top, int((e > 1e-12 * e[0]).sum()))
    assert len(got) == n * k
    z = np.array([[float(Fraction(a, n)) for a in r] for r in c]) @ u[:, :k] / np.sqrt(e[:k])
    want = sorted((usable[i][0] is None, usable[i][0] or 0, sum(a * a for a in c[i]), i) for i in range(n))
    mine = {}
    for r in got:
        mine.setdefault((r["vec_id"], r["deviation_text"]), []).append(r)
    for none, vec_id, deviation, i in want:
        rows_ = mine[None if none else vec_id, str(deviation)]
        assert {r["component"] for r in rows_} == set(range(1, k + 1)) and all(r["n"] == n for r in rows_)
        assert all(r["deviation"] == (deviation if deviation < 1 << 63 else None) for r in rows_)
        for r in rows_:
            assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-9
            assert r["identity_error"] < 1e-4
        for r in sorted(rows_, key=lambda r: r["component"]):
            assert any(abs(abs(r["whitened"]) - abs(z[j, r["component"] - 1])) < 1e-6 for _, _, _, j in want if usable[j][0] == usable[i][0]), (r, z[i])
    for comp in range(1, k + 1):  # one sign for all rows
        pairs = [(r["whitened"], z[i, comp - 1]) for _, vec_id, _, i in want for r in got if r["component"] == comp and r["vec_id"] == usable[i][0] and sum(1 for y in usable if y[0] == usable[i][0]) == 1]
        assert any(all(abs(a - sign * b) < 1e-6 for a, b in pairs) for sign in (1, -1))


def test_whitening(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(0, 0.3, 12) * np.linspace(1, 2, 12)).tolist()) for i in range(150)]
    rows += [(150, None), (151, [None] * 12), (152, [float("nan")] * 12), (153, [float("inf")] * 12), (154, []), (155, rows[0][1][:5]), (7, rows[9][1]), rows[8], (None, rows[3][1])]
    checked(whitening.digest(vectors(spark, rows)).collect(), rows, 12)


def test_whitening_without_variance(spark):
    assert whitening.digest(vectors(spark, [(1, [0.5, 0.25])])).collect() == []
    assert whitening.digest(vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect() == []
    assert whitening.digest(vectors(spark, [(1, []), (2, None)])).collect() == []
    flat = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]  # one component only
    got = whitening.digest(vectors(spark, flat)).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12
    checked(got, flat, 3)


def test_whitening_of_large_numbers(spark):
    """Neither products nor sums fit in 64 bits; finite entries of any size are held at the limits."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1e9, 4).tolist()) for i in range(40)]
    checked(whitening.digest(vectors(spark, rows)).collect(), rows, 4)
    rows.append((40, [3e38, -3e38, 1.0, 0.0]))
    got = whitening.digest(vectors(spark, rows)).collect()
    assert all(r["deviation"] is None for r in got if r["vec_id"] == 40) and all(math.isfinite(r["whitened"]) for r in got)
    assert all(abs(r["explained"] - 1) < 1e-9 for r in got if r["component"] == 1) and len({r["vec_id"] for r in got}) == 41


def test_residues():
    for bound in (1, 10**9, 10**40):
        p = whitening.primes(bound)
        assert math.prod(p) > 2 * bound and len(set(p)) == len(p)
        for x in (0, 1, -1, bound, -bound, bound // 3):
            assert whitening.restored([x % q for q in p], p) == x


# --- importance resampling

SCHEMA = "doc_id long, text string, score string, rank int"


def brute(docs, targets, share=25, least=20):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2) for i in range(len(w) - k + 1)]

    own, wanted = [features(t) for _, t in docs], [features(t) for t in targets]
    s, t = np.zeros(10_000), np.zeros(10_000)
    for n, f in own:
        np.add.at(s, f, 1)
    for n, f in wanted:
        np.add.at(t, f, 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t)]
    out = []
    for (doc_id, _), (n, f) in zip(docs, own):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    place = {id(r): k + 1 for k, r in enumerate(able[: share * len(able) // 100])}
    return [(r[0], r[1], r[2], r[3], place.get(id(r))) for r in out]


def documents(seed=3, n=120):
    rng = np.random.default_rng(seed)
    words = ["alpha", "Beta", "x1", "été", "日本", "don't", "a-b", "ΑΒΓ", "İx", "q"]
    docs = [(i, "  ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(n)]
    return docs + [docs[5], (n, None), (n + 1, ""), (n + 2, " \n.,;"), (None, docs[9][1]), (None, docs[10][1]), (n + 3, "word " * 30_000), (-4, "A" * 50_000)]


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_importance_resampling(spark, monkeypatch):
    docs = documents()
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA).repartition(4)
    targets = [docs[3][1], None, "alpha Beta alpha", docs[3][1]]
    bench = spark.createDataFrame([(t,) for t in targets], "text string")
    want = sorted_rows(brute(docs, targets))
    assert sorted_rows(importance.digest(importance.resample(df, bench)).collect()) == want
    # Chunks and parts of any size give the same.
    monkeypatch.setattr(importance, "CHUNK", 50)
    monkeypatch.setattr(importance, "PART", 37)
    assert sorted_rows(importance.digest(importance.resample(df, bench)).collect()) == want


def test_importance_resampling_empty(spark):
    docs = documents(n=30)
    df, none = spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA), spark.createDataFrame([], "text string")
    assert sorted_rows(importance.digest(importance.resample(df, none)).collect()) == sorted_rows(brute(docs, []))
    assert importance.resample(spark.createDataFrame([], SCHEMA), df).collect() == []


# --- WARC

PAGES = "page_id long, url string, html string, digest string, id int, record int, copies int"


def pages():
    long, other = "<p>é</p>" * 40, "y" * 100
    rows = [(i, f"http://a/{i}", f"<html>{i}" + "z" * (i * 7)) for i in range(40)]
    rows += [(100 + i, f"http://b/{i}", long) for i in range(30)]  # copies
    rows += [(200 + i, None, "short") for i in range(5)] + [(210, "u", None), (211, None, ""), (212, "u", None)]
    rows += [(220, "a b\r\nX: 1", other), (219, "q", other), (None, "n", other), (221, "e", "y" * 99), (222, "e", "y" * 99)]
    rows += [(300, "r", "w" * 200)] * 3 + [(None, None, "v" * 200), (None, "v", "v" * 200)]
    rows += [(400, "big", "\r\n\r\nWARC/1.1\r\n" * 20_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], PAGES).repartition(4)


def wanted(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2] or "", []).append(r)
    out = []
    for html, group in by.items():
        group.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
        payload = html.encode()
        for k, r in enumerate(group):
            revisit = k > 0 and len(payload) >= 100
            out.append((r[0], len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", group[0][0] if revisit else None))
    return sorted_rows(out)


@pytest.mark.parametrize("bound", [warc.BROADCAST_BYTES, 0])
def test_archive(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(warc, "PART", 4)
    rows = pages()
    archive = warc.write(frame(spark, rows), str(tmp_path / "a"))
    assert sorted_rows(warc.read(warc.originals(archive)).drop("url").collect()) == wanted(rows)
    # Each payload once, whatever its copies.
    assert sorted(bytes(r["payload"]) for r in archive.payloads.collect()) == sorted({(r[2] or "").encode() for r in rows})
    assert all(r["digest"] == hashlib.sha256(r["payload"]).digest() for r in archive.payloads.collect())
    # Names are of one record each; those referred to are responses.
    heads = [warc._fields(bytes(r["head"]).partition(b"\r\n\r\n")[0].partition(b"\r\n")[2]) for r in archive.records.collect()]
    names = {h["warc-record-id"]: h for h in heads}
    assert len(names) == len(rows)
    assert all(names[h["warc-refers-to"]]["warc-type"] == "response" for h in heads if h["warc-type"] == "revisit")


def test_hot_digests(spark, tmp_path, monkeypatch):
    """A digest that a third of all rows share, beside rows in pairs, where groups can't be broadcast."""
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    rows = [(i, "u", "hot" * 100 if i % 3 else f"{i // 6}" * 120) for i in range(4000)]
    archive = warc.write(frame(spark, rows), str(tmp_path / "a"))
    assert sorted_rows(warc.read(warc.originals(archive)).drop("url").collect()) == wanted(rows)


def test_files(spark, tmp_path):
    """Through WARC files, as other tools read them, and back."""
    rows = pages()
    archive = warc.write(frame(spark, rows), str(tmp_path / "a"))
    packed = warc.files(warc.originals(archive), 2_000)
    for r in packed.collect():
        (tmp_path / r["name"]).write_bytes(r["content"])
    found = spark.read.format("binaryFile").load(str(tmp_path / "*.warc.gz")).select(F.col("path").alias("name"), "content")
    assert found.count() > 3
    got = warc.read(warc.unpacked(found)).drop("url")
    assert sorted_rows(got.collect()) == wanted(rows)


def test_damage_is_found(spark, tmp_path):
    archive = warc.write(frame(spark, pages()), str(tmp_path / "a"))
    broken = warc.Archive(archive.payloads.withColumn("payload", F.encode(F.replace(F.decode("payload", "UTF-8"), F.lit("z"), F.lit("Z")), "UTF-8")), archive.records)
    with pytest.raises(Exception, match="doesn't have the payload"):
        warc.read(warc.originals(broken)).collect()


# --- long runs, sources without a word, shared ids


def test_entropy_of_very_long_runs(spark):
    """Linear in the run: one inlined image doesn't stop the job."""
    import time

    from varispark.llm import secrets

    rng = np.random.default_rng(4)
    alphabet = list(secrets.CLASSES[2][1])
    long = "".join(rng.choice(alphabet, 300_000))
    rows = [(0, f"data:{long}"), (1, "ab/" * 60_000), (2, "a-" * 50_000 + "1"), (3, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["extra"] for r in secrets.scan(df).collect()}
    assert time.time() - began < 60
    kind, _, _, window, bits = secrets.CLASSES[2]
    at = [s for s in got[0] if s["kind"] == kind]
    assert len(at) == 1 and at[0]["start"] < 100 and at[0]["end"] > 300_000 - 100
    assert got[1] == [] and got[3] == []


def test_sources_without_a_word(spark, tmp_path):
    import duckdb

    from varispark.llm import mixing, oracles

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, "one two three " * (i + 1), "en", "ab"[i % 2], 1) for i in range(8)]
    hollow = [(20 + i, (None, "", " \n")[i % 3], "en", "c", 0) for i in range(5)]
    for n, rows in enumerate((full + hollow, hollow, full + hollow + [(40, None, None, None, None)])):
        df = spark.createDataFrame(rows, schema).coalesce(1)
        got = sorted_rows(mixing.digest(mixing.mix(df)).select("doc_id", "size", "source_size", "target", "taken", "time").collect())
        df.write.parquet(str(tmp_path / f"d{n}"))
        want = duckdb.sql(oracles.op3().replace("documents", f"read_parquet('{tmp_path}/d{n}/*.parquet')")).fetchall()
        assert [r[:5] for r in got] == [r[:5] for r in sorted_rows(want)]
        assert [r[5] for r in got] == pytest.approx([r[5] for r in sorted_rows(want)])
        assert {r["doc_id"] for r in mixing.stream(df).collect()} == {r[0] for r in want if r[4]}


def test_search_with_shared_ids(spark, tmp_path):
    """Each row is a candidate for every other, whatever its id; huge and null ids, repeated rows, huge components."""
    import duckdb

    from varispark.llm import oracles, top_k

    rows = [(0, [0.5, 0.1]), (0, [0.9, 0.9]), (7, [0.3, 0.2]), (50, [0.9, 0.9]), (50, [0.9, 0.9]), (None, [0.8, 0.8]), ((1 << 63) - 1, [0.8, 0.8]), (3, None), (4, [float("nan"), 1.0]), (-50, [-0.5, 0.25]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    df.write.parquet(str(tmp_path / "v"))
    found = spark.read.parquet(str(tmp_path / "v"))
    for block in (2, 64):
        got = sorted_rows(top_k.search(found, "vec_id % 50 = 0", block=block).collect())
        some = duckdb.sql(oracles.op9().replace("FROM embeddings", f"FROM (SELECT vec_id, CASE WHEN len(embedding) = 0 THEN [0e0, 0e0] ELSE embedding END AS embedding FROM read_parquet('{tmp_path}/v/*.parquet'))")).fetchall()
        assert got == sorted_rows(some)
    big = spark.createDataFrame([(0, [1e300, -1e300]), (1, [1e300, 1.0]), (2, [-1e300, 1e300]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in top_k.search(big, "vec_id = 0").orderBy("rank").collect()] == [(1, (1 << 63) - 1), (3, 0), (2, -(1 << 63))]


# --- near copies where cells are dense, heavy or split


def test_unlike_sets_hide_no_near_copies():
    """All pairs with a common variant meet, however many unlike ones share it."""
    from varispark.llm import simhash

    rng = np.random.default_rng(21)
    n, width = 6000, 18  # about four variants to a value
    fp = rng.integers(0, 1 << width, n).astype(np.uint64)
    guard = rng.integers(0, 1 << 62, n).astype(np.uint64)
    for k in range(0, 2000, 2):  # near copies: up to four bits apart, guards alike
        bits = rng.choice(width, rng.integers(0, 5), replace=False)
        fp[k + 1] = fp[k] ^ np.uint64(sum(1 << int(b) for b in bits))
        guard[k + 1] = guard[k] ^ np.uint64(0b1011)
    place = rng.permutation(n)  # pairs don't stand side by side
    fp[place], guard[place] = fp.copy(), guard.copy()
    near = lambda a, b: np.bitwise_count(guard[a] ^ guard[b]) <= 6
    root = simhash.joined(fp, 0, 0, 2, near, width, every=True)
    assert all(root[place[k]] == root[place[k + 1]] for k in range(0, 2000, 2)) and len(np.unique(root)) == n - 1000
    alone = simhash.joined(fp, 0, 0, 2, near, width)
    assert sum(alone[place[k]] == alone[place[k + 1]] for k in range(0, 2000, 2)) < 1000


def test_heavy_cells_are_taken_apart(spark):
    """Fingerprints that agree in most bits: no cell holds them all, and no link is lost."""
    import pyarrow as pa

    from varispark.llm import near_copies, shared

    rng = np.random.default_rng(22)
    size, rows, pairs = near_copies.WIDTH // 8, [], []
    base = rng.integers(0, 256, near_copies.TABLES * size, dtype=np.uint8)
    for g in range(300):
        own = base.copy()
        for t in range(near_copies.TABLES):  # 12 of a table's bits are each set's own
            bits = rng.integers(0, 2, 12)
            for j, b in enumerate(bits):
                at = t * size + (3 * j) // 8
                own[at] = own[at] & ~np.uint8(1 << ((3 * j) % 8)) | np.uint8(int(b) << ((3 * j) % 8))
        other = own.copy()
        for t in range(near_copies.TABLES):
            for j in rng.choice(40, 3, replace=False):
                other[t * size + j // 8] ^= np.uint8(1 << (j % 8))
        guard = rng.integers(0, 256, near_copies.GUARD // 8, dtype=np.uint8)
        rows += [(2 * g, 100, bytearray(np.concatenate([own, guard]).tobytes())), (2 * g + 1, 100, bytearray(np.concatenate([other, guard]).tobytes()))]
        pairs.append((2 * g, 2 * g + 1))
    df = spark.createDataFrame(rows, "set long, n long, signature binary")
    shared.ship(spark)
    plan = near_copies.planned(df, len(rows), 20)
    assert plan.heavy and len(plan.heavy[0])
    largest = 0
    fps, _ = near_copies._tables(pa.array([bytes(r[2]) for r in rows], pa.binary()))
    for t, fp in enumerate(fps[:3]):
        for names, _, _ in plan.places(fp, t):
            largest = max(largest, int(np.unique(names, return_counts=True)[1].max()))
    assert largest < len(rows) / 4
    together = {}
    for r in near_copies.candidates(df, len(rows), 20).collect():
        together.setdefault((r["cell"], r["low"]), set()).add(r["set"])
    assert all(any(a in c and b in c for c in together.values()) for a, b in pairs)


def test_split_components_by_tiles(spark, monkeypatch):
    from varispark.llm import near_copies, shared, simhash

    rng = np.random.default_rng(23)
    sets = [np.unique(np.concatenate([rng.choice(np.arange(100, dtype=np.uint64), 92, replace=False), rng.integers(100, 200, 5).astype(np.uint64)])) for _ in range(60)]
    rows = [(k // 30, k, len(h), bytearray(h.tobytes())) for k, h in enumerate(sets)]
    members = spark.createDataFrame(rows, "key long, set long, n long, h binary")
    sizes = members.groupBy("key").agg(F.sum("n").alias("total"))
    shared.ship(spark)
    whole = {r["node"]: r["root"] for r in simhash.components(near_copies.bucketed(members, sizes)).collect()}
    monkeypatch.setattr(near_copies, "TILE", 500)
    tiled = {r["node"]: r["root"] for r in simhash.components(near_copies.bucketed(members, sizes)).collect()}
    assert tiled == whole and len(whole) > 5
