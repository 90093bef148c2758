"""The ten queries on small hostile tables, against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from varispark.llm import bit_planes, digests, language_id, line_dedup, mixing, near_copies, packing, queries, secrets, shared, simhash, token_counts, top_k
from varispark.llm.tokens import encoder, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, `__x y` int"
WORDS = {
    "en": "the of and to in that was with for which have from this were they their house river water people always never under window garden".split(),
    "fr": "le la les des une dans pour avec sur est sont pas plus cette maison rivière été très après toujours jamais fenêtre jardin où".split(),
    "de": "der die das und nicht mit für auf ist sind eine werden über haus fluß wasser menschen immer fenster garten schön können wäre".split(),
}
BASE64 = "q7Zt2Lw9XkP4vR8sYb1NcD5f"


def prose(lang, n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS[lang], n))


def make_docs():
    rows = []
    for i in range(48):
        lang = ("en", "fr", "de")[i % 3]
        text = "\n".join(prose(lang, 40, 10 * i + k) + "." for k in range(4))
        if i % 4 == 1:
            text = "Home | About | Contact\n" + text
        rows.append([i, text, lang, "hot" if i % 2 else f"s{i % 5}", len(text)])
    rows[3][1] = rows[6][1]  # copies
    rows[12][1] = rows[6][1].replace("the", "a", 1)
    rows[5][1] = f"password = hunter2hunter2 x AKIA{'A1' * 8} token: ab secret=token: abcdefgh {'0a1b2c3d' * 4} key {BASE64} end"
    rows[7][1] = "it's <|endoftext|> we'll  \n\n  x\t   日本語 naïve é 😀 12345 don't " + "a" * 300
    rows[8][1], rows[9][1], rows[10][1] = None, "", "  \n\t "
    rows[11][1] = "123 456 !!"
    rows[13][1] = prose("en", 6000, 99)
    rows[14][2] = rows[15][3] = None
    rows[16][1] = "x"
    rows.append(list(rows[20]))  # a repeated row
    rows.append([-5, "only three words", "en", None, 16])
    return [(*r, 7, "clash", 1) for r in rows]


@pytest.fixture(scope="module")
def docs():
    return make_docs()


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, SCHEMA).repartition(5).write.parquet(f"{at}/documents.parquet")
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.3, 12)], i % 3) for i in range(260)]
    vectors[3], vectors[4], vectors[5] = (3, None, 0), (4, [None] * 12, 0), (5, [float("nan")] * 12, 0)
    vectors[101] = (101, vectors[102][1], 0)
    vectors.append(vectors[7])
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(0, docs[0][1]), (1, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


def collect(spark, name, folder):
    (f,) = [q for k, q in queries.QUERIES.items() if k.startswith(name + "_")]
    return f(spark, folder).collect()


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def texts(docs):
    return {d[0]: d[1] or "" for d in docs}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    got = queries.QUERIES[name](spark, empty)
    assert got.collect() == []


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if not q.startswith(("op8", "op9", "op11", "op13"))])
def test_one_row_per_document(spark, folder, docs, name):
    got = queries.QUERIES[name](spark, folder).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d[0] for d in docs)


def test_secrets(spark, folder, docs):
    got = by_id(collect(spark, "op1", folder))
    for doc_id, text in texts(docs).items():
        spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        r = got[doc_id][0]
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert all(x in r["spans"] for x in want.split(","))
    assert got[5][0]["n_assign"] == 1 and got[5][0]["n_access"] == 1 and got[5][0]["n_hex"] == 1
    at = texts(docs)[5].index(BASE64)
    assert f"entropy_base64:{at}:" in got[5][0]["spans"]


def test_entropy_windows_are_exact(spark):
    import math

    rng = np.random.default_rng(8)
    kind, alphabet, _, window, bits = secrets.CLASSES[2]
    runs = ["".join(rng.choice(list("abcABC0123456789+/xyzw"), 70)), "ab" * 30 + BASE64 + "cd" * 30, "a1" * 12, "Ab3" * 200]
    df = spark.createDataFrame([(i, f"<{r}>") for i, r in enumerate(runs)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["extra"] if s["kind"] == kind] for r in secrets.scan(df).collect()}
    most = int((math.log2(window) - bits) * window * secrets.SCALE)
    for i, r in enumerate(runs):
        hot = [o for o in range(len(r) - window + 1) if sum(round(c * math.log2(c) * secrets.SCALE) for c in (r[o : o + window].count(a) for a in set(r[o : o + window]))) <= most]
        assert got[i] == ([(hot[0] + 1, hot[-1] + window + 1)] if hot else [])


def test_allow_list(spark):
    df = spark.createDataFrame([(0, "id 123e4567-e89b-12d3-a456-426614174000"), (1, "see some-very-long-but-plain-title-of-a-page"), (2, "key EXAMPLE" + BASE64)], "doc_id long, text string")
    assert [len(r["extra"]) for r in secrets.scan(df).orderBy("doc_id").collect()] == [0, 0, 0]


def test_token_counts(spark, folder, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(queries.BYTE_BPE))
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for doc_id, rows in by_id(collect(spark, "op2", folder)).items():
        t = texts(docs)[doc_id]
        for r in rows:
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n(t), n(t) > 512)
            assert n(t[: r["fit_chars"]]) <= 512 and (r["fit_chars"] == len(t) or n(t[: r["fit_chars"] + 1]) > 512)


def test_every_prefix_is_exact(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(queries.BYTE_BPE))
    own = token_counts.counter(tokenizer_path(queries.BYTE_BPE))
    for t in [texts(docs)[7], texts(docs)[5], texts(docs)[10], " a\n b \t c  'll 's 'r\n\n", "\n \n x", texts(docs)[1][:150], "a<|endoftext|> b<|endoftext|><|end"]:
        counts = own.counts(t)
        for k in range(len(t) + 1):
            assert counts.at(k) == len(library.encode(t[:k], add_special_tokens=False).ids), (t[:k], k)


def test_encoder_equals_library(docs):
    from tokenizers import Tokenizer

    for name in (queries.BYTE_BPE, queries.WORD_BPE):
        library, own = Tokenizer.from_file(tokenizer_path(name)), encoder(tokenizer_path(name))
        assert own.rule
        every = [*texts(docs).values(), "<|startoftext|> A  B<|endoftext|>C", "ÀÉ ÿ Ÿ ß İ ſ ﬁ", "x́ ́y"]
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in every]
        assert own.ids(every) == want


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixing(spark, folder, docs):
    got = collect(spark, "op3", folder)
    sizes = {}
    for d in docs:
        sizes[d[3]] = sizes.get(d[3], 0) + size_of(d[1])
    order = sorted(k for k in sizes if k is not None) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    left, share, full = float(sum(sizes.values())), dict(weight), {}
    while True:
        level = left / sum(share.values())
        over = [k for k in share if share[k] * level > 3 * sizes[k]]
        if not over:
            break
        for k in over:
            full[k] = 3.0 * sizes[k]
            left -= full[k]
            del share[k]
    target = full | {k: level * w for k, w in share.items()}
    source = {d[0]: d[3] for d in docs}
    taken = {}
    for r in got:
        k = source[r["doc_id"]]
        assert r["size"] == size_of(texts(docs)[r["doc_id"]]) and r["source_size"] == sizes[k]
        assert r["target"] == pytest.approx(target[k]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[k] = taken.get(k, 0) + r["taken"]
    for k, n in taken.items():
        assert n == int(target[k] + 1e-9)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, collect(spark, "op3", folder)), key=repr)


def test_curriculum_times(spark, docs):
    """Positions by the inverse equal those by integrating the schedule numerically."""
    mixed = mixing.mix(spark.createDataFrame(docs, SCHEMA), bucket_rows=7).collect()
    grid = np.linspace(0, 1, 200_001)
    tiers = {k: i % 3 for i, k in enumerate(sorted({d[3] for d in docs if d[3]}) + [None])}
    for r in mixed:
        rate = np.interp(grid, mixing.KNOTS, mixing.SCHEDULES[tiers[r["source"]]])
        demand = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        demand *= r["target"] / demand[-1]
        for p in r["passes"]:
            back = np.interp(p["time"], grid, demand)
            assert back <= r["target"] + 1e-6 and (back - p["pass"] * r["source_size"]) >= -1e-3 * r["target"] - 1


def test_stream_repeats_whole_rows(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    out = mixing.stream(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert rows and {tuple(r) for r in rows} <= {tuple(d) for d in docs}


def test_stream_has_every_source_that_the_target_reaches(spark):
    rows = [(2, prose("en", 900, 2), "a"), (1, prose("en", 3000, 1), "b"), (4, prose("en", 9000, 4), "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(df, weights=(5, 900, 1)).collect()}
    assert 0 < 2 * taken[4][0] < taken[4][1]
    assert {r["doc_id"] for r in mixing.stream(df, weights=(5, 900, 1)).collect()} == {d for d, (n, _) in taken.items() if n}


def test_language(spark, folder, docs):
    got = by_id(collect(spark, "op4", folder))
    right = n = 0
    for d in docs:
        r = got[d[0]][0]
        assert r["held_out"] == (zlib.crc32(str(d[0]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in d[1] or ""):
            assert r["lang_pred"] == "und" and r["score"] == 0
        elif r["held_out"] and d[2] and d[0] >= 14:
            right, n = right + (r["lang_pred"] == d[2]), n + 1
    assert n > 5 and right >= 0.9 * n


def test_phrases_equal_greedy_parse():
    sample = {"en": language_id.plain(prose("en", 200, 1)), "fr": language_id.plain(prose("fr", 200, 2))}
    own = language_id.Model(sample)
    cases = [language_id.plain(t) for t in (prose("en", 300, 3), prose("fr", 7, 4), "zzz qqq", "a", "日本 the", "日本" * 700 + prose("fr", 400, 5), prose("en", 9000, 6))]
    got = own.phrases(cases)
    for i, t in enumerate(cases):
        for k, lang in enumerate(own.langs):
            count = j = 0
            while j < len(t):
                m = 1
                while j + m <= len(t) and t[j : j + m] in sample[lang]:
                    m += 1
                count, j = count + 1 + (m == 1), j + max(1, m - 1)  # an unknown character takes two
            assert got[i, k] == count
    found = got * [math.log2(len(sample[x])) for x in own.langs]
    lang, score = own.predict(cases)
    assert lang == [own.langs[k] for k in found.argmin(axis=1)]
    assert score == pytest.approx((found.max(axis=1) / found.sum(axis=1)).tolist())


def test_numbers_are_no_letters():
    own = language_id.Model({"en": "some words"})
    assert own.predict(["² ½ Ⅷ ①", "12 ٣", "a²", None, ""])[0] == ["und", "und", "en", "und", "und"]


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "hello there", None), (2, None, None)], "doc_id long, text string, lang string")
    assert language_id.fit(df) == {}
    assert {r["lang_pred"] for r in language_id.identify(df, {}).collect()} == {"und"}


def test_languages_of_short_and_long_texts_are_learned(spark):
    import corpus_pipeline

    rows = [(i, " ".join(WORDS["en"][i % 9 : i % 9 + 4]), "en") for i in range(40)]
    rows += [(100 + i, "1" * 9000 + prose("fr", 2500, i), "fr") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.fit(df)
    assert sorted(sample) == ["en", "fr"] and all(len(x) > 500 for x in sample.values())
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, sample).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    one = df.where(language_id.held_out()).limit(1)  # the only label is held out
    assert corpus_pipeline.language_id(spark, one, "").count() == 1


def test_every_character_of_the_samples_counts():
    rng = np.random.default_rng(21)
    scripts = {"a": range(0x4E00, 0x4F80), "b": range(0x4F80, 0x5100), "c": range(0xAC00, 0xAD80)}  # 384 characters each
    prose_of = lambda s: "".join(map(chr, rng.choice(list(scripts[s]), 3000)))
    own = language_id.Model({s: prose_of(s) for s in scripts})
    for s in scripts:
        assert own.predict([prose_of(s)[:60]])[0] == [s]
    assert len(set(own.code[[ord(c) for lang in scripts for c in map(chr, scripts[lang])]])) > 1100
    strange = "".join(map(chr, range(0x10A0, 0x10C0)))  # in no sample: two phrases each
    assert (own.phrases([strange]) == 2 * len(strange)).all()


def test_moves_are_those_of_the_automaton():
    rng = np.random.default_rng(22)
    for symbols, n in ((3, 500), (40, 4000), (3000, 4000)):
        step = language_id.automaton((rng.zipf(1.3, n) % (symbols - 1) + 1).tolist())
        moves = language_id.Moves(step, symbols)
        names, stack = {1: int(moves.start)}, [1]
        while stack:
            s = stack.pop()
            for c, t in step[s].items():
                at = names[s] ^ c
                assert moves.own[at] == names[s] and names.setdefault(t, int(moves.next[at])) == moves.next[at]
                if s == 1:
                    assert moves.begin[c] == names[t]
            if s not in (seen := names.setdefault("seen", set())):
                seen.add(s)
                stack.extend(step[s].values())
        names.pop("seen")
        assert len(set(names.values())) == len(step) - 1 and (moves.own >= 0).sum() == sum(map(len, step))


def test_sample_is_of_60000_characters(spark):
    df = spark.createDataFrame([(4 * i, prose("en", 1500, i), "en") for i in range(20)], "doc_id long, text string, lang string")
    assert len(language_id.fit(df, learn=df["lang"].isNotNull())["en"]) == 60_000


def test_bit_planes(spark, folder, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(queries.WORD_BPE))
    got = by_id(collect(spark, "op5", folder))
    at, count = 0, {}
    for d in sorted(docs, key=lambda d: d[0]):
        ids = library.encode(d[1] or "", add_special_tokens=False).ids + [2]
        r = sorted(got[d[0]], key=lambda r: r["start"])[count.get(d[0], 0)]
        count[d[0]] = count.get(d[0], 0) + 1
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("bits", [1, 8])
def test_plane_file_round_trip(bits):
    import io

    rng = np.random.default_rng(6)
    docs = [(None if i == 0 else i * 3 - 5, rng.integers(0, 1 << int(rng.integers(1, 32)), int(rng.integers(0, 900))).astype("<u4")) for i in range(60)]
    sink = io.BytesIO()
    writer = bit_planes.Writer(sink, bits, chunk_ids=256)
    for d, ids in docs:
        writer.add(d, ids.tobytes())
    writer.close()
    reader = bit_planes.Reader(io.BytesIO(sink.getvalue()))
    back = list(reader.documents())
    assert [d for d, _ in back] == [d for d, _ in docs] and all((a == b).all() and len(a) == len(b) for (_, a), (_, b) in zip(back, docs))
    every = np.concatenate([ids for _, ids in docs])
    assert (reader.ids(300, 1234) == every[300:1234]).all()
    broken = bytearray(sink.getvalue())
    broken[-20] ^= 255
    with pytest.raises(ValueError):
        bit_planes.Reader(io.BytesIO(bytes(broken)))


def test_line_dedup(spark, folder, docs):
    got = by_id(collect(spark, "op6", folder))
    pages, count = {}, {}
    for d in docs:
        pages[d[3]] = pages.get(d[3], 0) + 1
        for line in {x.strip(" \t\r\x0b\x0c") for x in (d[1] or "").split("\n") if d[1] is not None}:
            count[d[3], line] = count.get((d[3], line), 0) + 1
    dropped = 0
    for d in docs:
        gone = lambda x: len(x) >= 3 and count[d[3], x] >= 5 and count[d[3], x] > 0.1 * pages[d[3]]
        lines = [] if d[1] is None else d[1].split("\n")
        kept = [x for x in lines if not gone(x.strip(" \t\r\x0b\x0c"))]
        r = got[d[0]][0]
        assert (r["n_lines"], r["n_dropped"]) == (len(lines), len(lines) - len(kept))
        assert r["kept_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()
        dropped += len(lines) - len(kept)
    assert dropped


def test_line_dedup_without_broadcast(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(docs, SCHEMA)
    want = sorted(map(tuple, line_dedup.clean(df, F.col("source")).collect()), key=repr)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, line_dedup.clean(df, F.col("source")).collect()), key=repr) == want


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, folder, docs):
    got = by_id(collect(spark, "op7", folder))
    ids = sorted(texts(docs))
    fps = [plain_fingerprint(texts(docs)[d]) for d in ids]
    for d, fp, root in zip(ids, fps, closure(fps)):
        for r in got[d]:
            assert (r["fingerprint"], r["component_id"]) == (f"{fp:016x}", ids[root])
    assert len({r["component_id"] for rs in got.values() for r in rs}) < len(ids)


@pytest.mark.parametrize("group", [1, 7, 10_000])
def test_ball_links_lose_nothing(spark, group):
    rng = np.random.default_rng(9)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    for _ in range(170):  # chains and clusters of up to five flips
        x = fps[int(rng.integers(0, len(fps)))]
        for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            x ^= 1 << int(b)
        fps.append(x)
    fps = sorted(set(fps))
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), len(fps), group=group)
    found = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in simhash.components(edges).collect()}
    want = closure(fps)
    groups = {}
    for x, r in zip(fps, want):
        groups.setdefault(r, set()).add(x)
    mine = {}
    for x in fps:
        mine.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_heavy_leads_are_told_apart(spark):
    rng = np.random.default_rng(12)
    top = 0b1011 << 60
    fps = {top | int(x) for x in rng.integers(0, 1 << 24, 300)} | {int(x) for x in rng.integers(0, 1 << 62, 40)}
    for x in list(fps)[:120]:
        for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    bits, heavy = simhash.heavy_leads(df, len(fps), 8)
    assert bits and len(heavy) > 3
    found = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in simhash.components(simhash.links(df, len(fps), group=8)).collect()}
    want, mine = {}, {}
    for x, r in zip(fps, closure(fps)):
        want.setdefault(r, set()).add(x)
        mine.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("group, times", [(1 << 20, 1), (40, 1), (40, 100)])
def test_candidates_at_a_similarity_of_08(spark, group, times):
    rng = np.random.default_rng(13)
    rows, pairs = [], []
    for g in range(200):
        base = np.unique(rng.integers(0, 1 << 62, 130, dtype=np.uint64))
        a, b = base[:100], np.concatenate([base[:89], base[100:111]])  # 89 of 111
        for k, h in enumerate((a, b)):
            rows.append((2 * g + k, len(h), bytearray(near_copies.signature(np.sort(h)).tobytes())))
        pairs.append((2 * g, 2 * g + 1))
    assert len(near_copies.cells(times * len(rows), group)[1]) == {(1 << 20, 1): 1, (40, 1): 5, (40, 100): 15}[group, times]
    shared.ship(spark)
    met = near_copies.candidates(spark.createDataFrame(rows, "set long, n long, signature binary"), times * len(rows), group).collect()
    cells = {}
    for r in met:
        cells.setdefault((r["cell"], r["low"]), set()).add(r["set"])
    found = sum(any(a in c and b in c for c in cells.values()) for a, b in pairs)
    assert found >= 198 and all(len(c) < 10 for c in cells.values())


def test_group_links_in_parts(monkeypatch):
    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    near = base ^ np.uint64(0b1011) ^ (np.uint64(1) << np.uint64(50))
    fps = np.unique(np.concatenate([base, near]))
    whole = simhash.group_links(0, fps, 0, 2)
    monkeypatch.setattr(simhash, "SORTED", 10_000)
    parts = simhash.group_links(0, fps, 0, 2)
    assert sorted(zip(*map(list, whole))) == sorted(zip(*map(list, parts))) and len(whole[0]) == 40


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 100)], "a long, b long")
    assert {r["node"]: r["root"] for r in simhash.components(edges).collect()} == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}


def test_keep_first(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    every = sorted(texts(docs))
    roots = closure([plain_fingerprint(texts(docs)[d]) for d in every])
    assert sorted(ids) == sorted({every[r] for r in roots})


def near_closure(every):
    """Smallest index of each text's component, by Jaccard similarities of all pairs."""
    sets = []
    for t in every:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("block, columns", [(1024, 2048), (5, 30)])
def test_near_copies_from_a_similarity_of_08(spark, monkeypatch, block, columns):
    """Ball hashing over several fingerprints, against the closure of all pairs."""
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "COLUMNS", columns)
    rng = np.random.default_rng(31)
    rows = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 4000, 150)]
        for k in range(8):
            copy = list(base)
            for at in rng.choice(150, k // 2, replace=False):  # scattered edits: similarities about 0.75 to 1
                copy[at] = f"e{rng.integers(0, 4000)}"
            rows.append((" ".join(copy),))
    rows += [(None,), ("",), (" x ",), ("X",), ("one two three",), ("one two four",)]
    rows = [(i, t) for i, (t,) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = near_closure([t for _, t in rows])
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert len(set(want)) < 40


def test_bucket_links_are_all_similar_pairs(monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    monkeypatch.setattr(near_copies, "COLUMNS", 9)
    rng = np.random.default_rng(32)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 92, replace=False), rng.integers(100, 200, 5).astype(np.uint64)])) for _ in range(30)]
    a, b = near_copies.bucket_links(np.arange(30), sets)
    found = list(range(30))
    for x, y in zip(a, b):
        found[y] = x
    root = list(range(30))
    for i in range(30):
        for j in range(i):
            if near_copies.similar(sets[i], sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    assert found == root and 1 < len(set(root)) < 30


@pytest.mark.parametrize("module", [simhash, near_copies])
def test_one_row_of_each_component_with_repeated_and_null_ids(spark, module):
    a, b, c, d = (prose("en", 60, 40 + i) for i in range(4))
    rows = [(3, a), (7, a), (7, b), (7, c), (9, c), (None, a), (None, d), (None, d), (None, "")]
    kept = module.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(3, a), (7, b), (7, c), (None, d), (None, "")], key=repr)


def test_packing(spark, folder, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(queries.BYTE_BPE))
    rows = collect(spark, "op8", folder)
    got = by_id(rows)
    for d, t in texts(docs).items():
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        copies = sum(x[0] == d for x in docs)
        by_piece = sorted(got[d], key=lambda r: (r["piece"], r["sequence_id"], r["offset"]))
        assert len(by_piece) == copies * max(1, -(-len(ids) // 1024))
        for r in by_piece:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] <= 1024 and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r["piece"] == 0 or r["length"] == 1024
        assert sum(r["length"] for r in by_piece) == copies * len(ids)
    where = {}
    for r in rows:
        where.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in where.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_plan_places_all():
    rng = np.random.default_rng(11)
    for capacity, most in ((64, 400), (64, 3), (1024, 60), (10, 5)):
        h = rng.integers(0, most, capacity + 1)
        h[0] = 0
        plan = packing.best_plan(h, capacity)
        length = np.repeat(np.arange(capacity + 1), h)
        number = np.concatenate([np.arange(n) for n in h])
        sequence, offset = plan.place(length, number)
        order = np.lexsort((offset, sequence))
        s, o, n = sequence[order], offset[order], length[order]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        assert (o[first] == 0).all() and (o[1:][~first[1:]] == (o + n)[:-1][~first[1:]]).all()
        total = np.bincount(s, weights=n)
        assert total.max() <= capacity and len(total) == plan.sequences
        bound = max(-(-int(length.sum()) // capacity), int(h[capacity // 2 + 1 :].sum()))
        assert plan.sequences <= bound * 1.02 + 2


def test_top_k(spark, folder):
    got = sorted(tuple(r) for r in collect(spark, "op9", folder))
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    good = [(r["vec_id"], np.floor(256 * np.array(r["embedding"], dtype=float)).astype(int)) for r in rows if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    want = []
    for q, v in good:
        if q % 50 == 0:
            scores = sorted((-int(v @ w), i) for i, w in good if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert got == sorted(want)


def test_small_blocks_and_few_rows(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(90)]  # many ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k.search(df, "vec_id % 10 = 0", k=7, block=16).collect())
    want = []
    for q in range(0, 90, 10):
        s = sorted((-256 * 256 * int(np.dot(rows[q][1], w)), i) for i, w in rows if i != q)[:7]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert got == sorted(want)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert len(top_k.search(few, "vec_id = 0").collect()) == 2


def test_top_k_of_repeated_and_null_ids_is_that_of_the_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(15)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in [0, 0, 0, 50, 50, 7, 7, 8, 9, 10, 11, None, None]]
    rows[1] = rows[0]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL["op9_top_k"]).fetchall()
    assert sorted(map(repr, map(tuple, queries.op9_top_k(spark, str(tmp_path)).collect()))) == sorted(map(repr, want))


def test_fingerprints(spark, folder, docs):
    rows = by_id(collect(spark, "op10", folder))
    order = sorted(docs, key=lambda d: d[0])
    for i, d in enumerate(order):
        t, after = d[1] or "", order[(i + 1) % len(order)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        r = rows[d[0]][0]
        if sum(x[0] == d[0] for x in docs) == 1:
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["n_chars"] == len(t) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert r["near_edited"] == 1 if edited == t else r["near_edited"] >= 0
    assert rows[3][0]["fingerprint"] == rows[6][0]["fingerprint"] and rows[8][0]["fingerprint"] == ""
    long = [rs[0] for d, rs in rows.items() if len(texts(docs)[d]) > 500]
    assert np.median([r["near_edited"] for r in long]) > 0.5 > np.median([r["near_next"] for r in long])


def plain_digest(text, rank):
    """The chain of filters of one text, window by window."""
    w, span = digests.WINDOW, digests.SPAN
    data = text if len(text) >= w or not text else text + bytes(w - len(text))
    keys = []
    for i in range(len(data) - w + 1 if data else 0):
        counts = np.bincount(np.frombuffer(data[i : i + w], np.uint8))
        keys.append((int(rank[int(digests._SUMS[counts].sum()) // digests.STEP]), i))
    points = [0] * len(keys)
    for i in range(len(keys)):
        points[min(keys[i : i + span])[1]] += 1
    chosen = [i for i, n in enumerate(points) if n >= digests.POINTS] or [min(keys)[1] for _ in keys[:1]]
    filters = []
    for k, i in enumerate(chosen):
        if k % digests.FILTER_FEATURES == 0:
            filters.append(set())
        h = 0x9E3779B97F4A7C15
        for at in (0, 8):
            h = ((h ^ int.from_bytes(data[i + at : i + at + 8], "little")) * 0xBF58476D1CE4E5B9) % (1 << 64)
            h = ((h ^ (h >> 29)) * 0x94D049BB133111EB) % (1 << 64)
            h ^= h >> 32
        filters[-1] |= {(h >> (11 * j)) % digests.FILTER_BITS for j in range(5)}
    return filters


def plain_likeness(f, g):
    if not f or not g:
        return float(len(f) == len(g))
    if (len(f), sum(map(len, f))) > (len(g), sum(map(len, g))):
        f, g = g, f
    total = 0.0
    for a in f:
        best = 0.0
        for b in g:
            most, chance = min(len(a), len(b)), len(a) * len(b) / digests.FILTER_BITS
            share = (len(a & b) - chance) / (most - chance) if most > chance else float(len(a & b) == most)
            best = max(best, min(1.0, max(0.0, share)))
        total += len(a) * best
    return total / sum(map(len, f))


@pytest.mark.parametrize("bucket_rows", [2_000, 7])
def test_fingerprints_equal_plain_ones(spark, folder, docs, monkeypatch, bucket_rows):
    """Selection, filters and likeness of the whole query, with ids that rows share and null ids."""
    monkeypatch.setattr(digests, "BUCKET_ROWS", bucket_rows)
    rows = [(d[0], d[1]) for d in docs] + [(None, prose("en", 50, 71)), (None, None)] + [(9, prose("fr", 30, 80 + i)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    rank = digests.rarity(df)
    tie = {t: k for t, k in spark.createDataFrame([(t or "",) for _, t in rows], "text string").selectExpr("text", "xxhash64(text)").collect()}
    order = sorted(((-math.inf if d is None else d, tie[t or ""], t or "") for d, t in rows))
    want = []
    for i, (d, _, t) in enumerate(order):
        after = order[(i + 1) % len(order)][2]
        n = len(t) // 4
        new = t[: len(t) - n] + after[:n]
        own, other, following = (plain_digest(x.encode(), rank) for x in (t, new, after))
        text = lambda f: b"".join(sum(1 << b for b in s).to_bytes(digests.FILTER_BITS // 8, "little") for s in f).hex()
        want.append((None if d == -math.inf else d, len(t), hashlib.sha256(new.encode()).hexdigest(), text(own), text(other), round(plain_likeness(own, other), 9), round(plain_likeness(own, following), 9)))
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, digests.with_next(df, rank).collect())]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entropies_are_exact():
    rng = np.random.default_rng(13)
    data = [bytes(rng.integers(97, 105, 90).astype(np.uint8)), b"", b"short", bytes(200)]
    b, begin, windows = digests.laid_out(data)
    got = digests.entropy_entries(b)
    for k, n in zip(begin, windows):
        for i in range(k, k + n):
            counts = np.bincount(b[i : i + digests.WINDOW])
            assert got[i] == int(digests._SUMS[counts].sum()) // digests.STEP


def test_equal_texts_in_other_company():
    rng = np.random.default_rng(14)
    data = [bytes(rng.integers(97, 122, int(n)).astype(np.uint8)) for n in rng.integers(0, 3000, 12)]
    rank = digests.ranks(digests.histogram(data))
    alone = [digests.fingerprints([t], rank)[0] for t in data]
    together = digests.fingerprints(data, rank)
    assert all(a.tobytes() == b.tobytes() for a, b in zip(alone, together))
    assert all(digests.likeness(a, a) == 1 for a in alone)
    assert digests.likeness(alone[0], alone[1]) == digests.likeness(alone[1], alone[0])


def test_pipeline(spark, folder, docs):
    import corpus_pipeline

    df = spark.read.parquet(f"{folder}/documents.parquet")
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    first = corpus_pipeline.STAGES[0][1](spark, df, folder)
    assert sorted(r["doc_id"] for r in first.collect()) == sorted(d[0] for d in docs if any(c.isalpha() for c in d[1] or ""))
    assert first.columns == df.columns
    second = corpus_pipeline.STAGES[1][1](spark, df, folder)
    assert second.columns == df.columns and second.count() == len(docs)
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and {r["doc_id"] for r in out} <= {d[0] for d in docs}


def plain_pipeline(docs):
    """Texts and repeats of the five stages by doc_id; ids must not be shared by different texts."""
    rows = [(d[0], d[1], d[3]) for d in docs if any(c.isalpha() for c in d[1] or "")]
    strip = lambda x: x.strip(" \t\r\x0b\x0c")
    pages, count = {}, {}
    for _, t, s in rows:
        pages[s] = pages.get(s, 0) + 1
        for line in {strip(x) for x in t.split("\n")}:
            count[s, line] = count.get((s, line), 0) + 1
    gone = lambda s, x: len(x) >= 3 and count[s, x] >= 5 and count[s, x] > 0.1 * pages[s]
    rows = [(d, "\n".join(x for x in t.split("\n") if not gone(s, strip(x))), s) for d, t, s in rows]
    rows.sort(key=lambda r: r[0])
    rows = [rows[i] for i in sorted(set(near_closure([t for _, t, _ in rows])))]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size_of(t)
    order = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    share, full, left = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}, {}, float(sum(sizes.values()))
    while over := [k for k in share if share[k] * left / sum(share.values()) > 3 * sizes[k]]:
        for k in over:
            full[k] = 3.0 * sizes[k]
        left -= sum(full[k] for k in over)
        share = {k: w for k, w in share.items() if k not in over}
    target = full | {k: left * w / sum(share.values()) for k, w in share.items()}
    start, repeats = {}, {}
    for d, t, s in sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()):
        n, at = size_of(t), start.get(s, 0)
        words = [min(n, int(target[s] + 1e-9) - p * sizes[s] - at) for p in range(4)]
        repeats[d] = sum(w > 0 and (p == 0 or 2 * w >= n) for p, w in enumerate(words))
        start[s] = at + n
    return {d: t for d, t, _ in rows}, repeats


def test_pipeline_equals_plain_stages(spark, folder, docs):
    from tokenizers import Tokenizer

    import corpus_pipeline

    library = Tokenizer.from_file(tokenizer_path(queries.BYTE_BPE))
    kept, repeats = plain_pipeline(docs)
    want, got, where = [], [], {}
    for d, t in kept.items():
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want += [(d, zlib.crc32(ids.tobytes()))] * repeats[d] if len(ids) <= 1024 else [(d, len(ids))] * repeats[d]
    long = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        where.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = library.encode(kept[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        if len(ids) <= 1024:
            got.append((r["doc_id"], r["ids_crc32"]))
        else:
            long[r["doc_id"]] = long.get(r["doc_id"], 0) + r["length"]
            got += [(r["doc_id"], len(ids))] if r["start"] == 0 else []
    assert sorted(got) == sorted(want) and len(want) > len(kept) > 30
    for d, n in long.items():
        assert n == repeats[d] * (len(library.encode(kept[d], add_special_tokens=False).ids) + 1)
    for parts in where.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_scratch_is_released(spark):
    import os

    before = shared.materialize(spark.range(3), "x")
    with shared.Scope() as own:
        df = shared.materialize(spark.range(4), "y")
    after = shared.materialize(spark.range(5), "z")
    (path,) = [p.removeprefix("file://") for _, p in own.own]
    assert df.count() == 4 and os.path.exists(path)
    own.end()
    assert not os.path.exists(path) and before.count() == 3 and after.count() == 5




CLASHES = "__row_id __row_key __row_one __mix_key __mix_time __line_host __line_n __line_dropped __stage_n id key bucket block lead set n start fp text_key tie tail size piece length q v".split()


@pytest.fixture(scope="module")
def hostile(spark, docs, tmp_path_factory):
    """Null ids, ids shared by different texts, texts beyond 35,000 bytes, and columns with the operators' own names."""
    rows = [tuple(d[:5]) for d in docs] + [(None, prose("en", 60, 200 + i), "en", "hot", 1) for i in range(9)] + [(None, None, None, None, None)] * 2
    rows += [(4, prose("fr", 50, 300 + i), "fr", f"s{i}", 1) for i in range(5)] + [(4, None, "fr", "s0", 1), (900, "längé " * 9_000, "de", "s1", 1), (901, "x" * 40_000, "de", "s1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, c in enumerate(CLASHES):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(i % 3))
    path = tmp_path_factory.mktemp("hostile")
    df.write.parquet(f"{path}/documents.parquet")
    clean = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    other = tmp_path_factory.mktemp("clean")
    clean.write.parquet(f"{other}/documents.parquet")
    return rows, str(path), str(other)


@pytest.mark.parametrize("name, columns", [
    ("op1", ("n_assign", "n_hex", "base_sha256", "spans")), ("op2", ("n_bytes", "n_tokens", "over_limit")), ("op3", ("size", "source_size", "target")), ("op5", ("n_tokens", "ids_crc32")),
    ("op6", ("n_lines", "n_dropped", "kept_sha256")), ("op7", ("fingerprint",)), ("op8", ("piece", "start", "length", "ids_crc32")), ("op10", ("n_chars", "fingerprint")),
])
def test_hostile_rows_are_as_those_with_ids_of_their_own(spark, hostile, name, columns):
    rows, path, clean = hostile
    got = [(r["doc_id"], *[r[c] for c in columns]) for r in collect(spark, name, path)]
    want = [(rows[r["doc_id"]][0], *[r[c] for c in columns]) for r in collect(spark, name, clean)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_hostile_rows_in_order(spark, hostile):
    rows, path, _ = hostile
    at = 0
    for r in sorted(collect(spark, "op5", path), key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(collect(spark, "op5", path), key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d)) and len(order) == len(rows)
    sizes, taken = {}, {}
    for r in collect(spark, "op3", path):
        assert r["taken"] <= 3 * r["size"]
        taken[r["target"]] = taken.get(r["target"], 0) + r["taken"]
    assert all(n in (int(t), int(t + 1e-6)) or n % int(t) == 0 for t, n in taken.items() if t >= 1)
    assert len(collect(spark, "op4", path)) == len(rows)
    groups = {}
    for r in collect(spark, "op7", path):
        groups.setdefault(r["fingerprint"], set()).add(r["component_id"])
    assert all(len(c) == 1 for c in groups.values())


def test_hostile_rows_through_the_stages(spark, hostile):
    import corpus_pipeline

    rows, path, _ = hostile
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    have = {(r[0], r[1]) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, path), name)
        assert docs.columns == names
        assert {(r["doc_id"], r["text"]) for r in docs.collect()} <= have or name != "language_id"
        assert {tuple(r[c] for c in CLASHES) for r in docs.collect()} == {tuple(r[c] for c in CLASHES) for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    ids = [r["doc_id"] for r in docs.collect()]
    assert None in ids and 900 in ids and 4 in ids
    assert corpus_pipeline.run(spark, path).count() > 50
