"""Each training-data operator against a plain version over a small table with the awkward cases in it."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dopplerlake.llm import ann, bpe, common, crf, html_text, maxent_lm, media, packing, preference, simhash, suffix_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows(spark):
    got = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    long = " ".join(r[1] for r in got[:60])
    odd = [
        (10_000, None, "en", "x", None), (10_001, "", "en", "x", 0), (10_002, "  \n\t ", None, None, 5), (10_003, "ab", "en", "x", 2), (10_004, "12 34 !!", "en", "x", 8),
        (10_005, "a <|endoftext|> b<|endoftext|>", "en", "x", 1), (10_006, "tab\there  two\n\n three   x 　y it's we'll I'D 数字１２ 🙂🙂 é", "en", "x", 1),
        (10_007, long, None, "x", len(long)), (10_008, "x" * 3000, "en", "x", 3000), (10_009, "ab " * 900, "en", "x", 2700), (10_010, "é" * 700, "fr", "x", 700),
        (10_011, got[0][1] * 3, got[0][2], "x", 1), (None, got[1][1], got[1][2], "x", 1), (got[3][0], got[3][1], got[3][2], "x", 1), (10_012, got[5][1], got[5][2], "x", 1),
    ]
    return got + odd


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(common.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts], t


def test_bpe(docs, rows, empty):
    ids, t = reference_ids([r[1] for r in rows])
    want = sorted((r[0] or -1, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(i, skip_special_tokens=False).encode()).hexdigest()) for r, i in zip(rows, ids))
    assert sorted((r[0] or -1, *r[1:]) for r in bpe.op2_bpe_round_trip(docs).collect()) == want
    assert bpe.op2_bpe_round_trip(empty).count() == 0


def test_bpe_long_words_take_the_same_merges():
    e = bpe.encoder(common.tokenizer_path())
    rng = np.random.default_rng(1)
    for n in (5, 60, 191):
        word = bytes(rng.choice(list(b"abcdeth "), n).tolist())
        assert e.merge(word) == e._merge_long([e.single[b] for b in word])


def test_packing(docs, rows, empty):
    ids, _ = reference_ids([r[1] for r in rows])
    want = Counter()
    for r, i in zip(rows, ids):
        i = [*i, 0]
        n = len(i)
        first = n if n <= 2048 else n % 2048 or 2048
        cuts = [0, *range(first, n, 2048), n]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                want[r[0], k, a, b - a, zlib.crc32(np.array(i[a:b], "<u4").tobytes())] += 1
    got = packing.op9_packing(docs).collect()
    assert Counter(tuple(r[:5]) for r in got) == want
    check_sequences(got, slack=2)
    assert packing.op9_packing(empty).count() == 0


def check_sequences(got, slack):
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= packing.lower_bound(np.array([r["length"] for r in got]), 2048) + slack


def test_packing_exchanges_between_partitions(spark):
    rng = np.random.default_rng(2)
    items = [(i, 0, 0, int(n), 7) for i, n in enumerate(np.minimum(2048, rng.lognormal(6.3, 0.8, 3000).astype(int) + 1))]
    got = packing.pack(spark.createDataFrame(items, packing.PIECE), per_partition=300).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    check_sequences(got, slack=3)


def test_certified_partitions_keep_their_bins(spark):
    rng = np.random.default_rng(5)
    items = [(i, 0, 0, int(n), 7) for i, n in enumerate(rng.integers(1100, 1400, 2000))]
    got = packing.pack(spark.createDataFrame(items, packing.PIECE), per_partition=100).collect()
    tasks = Counter(r["sequence_id"] >> 32 for r in got)
    assert len({r["sequence_id"] for r in got}) == 2000 and max(tasks.values()) <= 110
    assert sum(n for task, n in tasks.items() if task < 1 << 24) == 1980  # all but one bin of each partition stay where they are


def test_no_task_packs_more_than_its_share(spark):
    rng = np.random.default_rng(6)
    items = [(i, 0, 0, int(n), 7) for i, n in enumerate(np.concatenate([rng.integers(1100, 1400, 1500), rng.integers(1, 700, 1500)]))]
    got = packing.pack(spark.createDataFrame(items, packing.PIECE), per_partition=200).collect()
    assert max(Counter(r["sequence_id"] >> 32 for r in got).values()) <= 220
    check_sequences(got, slack=15)


def test_best_fit_decreasing_against_all_packings():
    """On a few items: never below the bound, at most 11/9 of the optimum and 6/9."""
    rng = np.random.default_rng(7)

    def best(items, room):
        if not items:
            return len(room)
        n, least = items[0], 99
        for i in {r: i for i, r in enumerate(room) if r >= n}.values():
            least = min(least, best(items[1:], (*room[:i], room[i] - n, *room[i + 1 :])))
        return min(least, best(items[1:], (*room, 100 - n)))

    for _ in range(30):
        items = rng.integers(5, 90, 8)
        optimum = best(sorted(items.tolist(), reverse=True), ())
        _, _, room = packing.best_fit_decreasing(items, 100)
        assert packing.lower_bound(items, 100) <= optimum <= len(room) <= 11 / 9 * optimum + 6 / 9


def test_lower_bound_is_a_bound():
    assert packing.lower_bound(np.array([1025] * 7), 2048) == 7
    assert packing.lower_bound(np.array([683] * 6), 2048) == 3
    assert packing.lower_bound(np.array([], np.int64), 2048) == 0


def test_media(docs, rows):
    got = media.op10_media(docs).collect()
    want = Counter()
    for r in rows:
        p = media.padded((r[1] or "").encode())
        m = media.store(p)
        want[r[0], len((r[1] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest()] += 1
        assert p in m and media.read_back(m)[0] == p
    assert Counter(tuple(x)[:7] for x in got) == want


def fragmented(parts, defaults=True):
    """A movie without samples of its own, and two fragments: runs with all fields, with defaults, and one that goes on after another."""
    import struct

    b, f = media.box, media.full
    empty = b(b"stbl", f(b"stsd", struct.pack(">I", 1), b(b"raw ", bytes(28))), f(b"stts", bytes(4)), f(b"stsc", bytes(4)), f(b"stsz", bytes(8)), f(b"stco", bytes(4)))
    trak = b(b"trak", f(b"tkhd", struct.pack(">IIII", 0, 0, 7, 0), bytes(64)), b(b"mdia", f(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), b(b"minf", empty)))
    out = b(b"ftyp", b"isom") + b(b"moov", trak, b(b"mvex", f(b"trex", struct.pack(">IIIII", 7, 1, 40, 9, 0x10000))))
    sync, plain = 0x2000000, 0x10000
    for k, samples in enumerate(parts):
        if k % 2 == 0:
            rows = b"".join(struct.pack(">III", 30, len(x), sync if i % 3 == 0 else plain) for i, x in enumerate(samples))
            run = lambda at: f(b"trun", struct.pack(">Ii", len(samples), at), rows, flags=0x701)
            traf = lambda at: b(b"traf", f(b"tfhd", struct.pack(">I", 7), flags=0x20000), run(at))
        else:  # equal samples by the movie's defaults, the first a sync sample, in two runs
            half = len(samples) // 2
            first = lambda at: f(b"trun", struct.pack(">IiI", half, at, sync), flags=0x5)
            traf = lambda at: b(b"traf", f(b"tfhd", struct.pack(">I", 7)), first(at), f(b"trun", struct.pack(">I", len(samples) - half)))
        moof = lambda at: b(b"moof", f(b"mfhd", struct.pack(">I", k)), traf(at))
        out += moof(len(moof(0)) + 8) + b(b"mdat", b"".join(samples))
    return out


def test_media_fragments():
    one, two = [bytes([65 + i]) * (5 + i) for i in range(7)], [bytes([97 + i]) * 9 for i in range(5)]
    data = fragmented([one, two, one])
    payload, tracks = media.read_back(data)
    assert payload == b"".join(one + two + one)
    t = tracks[0]
    assert (t["codec"], len(t["sizes"]), t["duration"]) == ("raw ", 19, 7 * 30 + 5 * 40 + 7 * 30)
    assert [data[a:b] for a, b in t["keyframes"].tolist()] == [one[0], one[3], one[6], two[0], one[0], one[3], one[6]]
    assert media.feature(tracks).startswith("codec=raw;seconds=0.620000;samples=19;keyframes=7;")


def test_broken_containers_raise_one_kind_of_error():
    import struct

    whole = media.store(media.padded(b"x" * 2000))
    no_samples = fragmented([])
    stray = no_samples + media.box(b"moof", media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 8))))
    headless = no_samples + media.box(b"moof", media.box(b"traf", media.full(b"trun", struct.pack(">I", 1))))
    far = whole.replace(b"stco" + bytes(4) + struct.pack(">I", 1), b"stco" + bytes(4) + struct.pack(">I", 1))[: -600 - 8] + b""
    for data in (b"", b"short", whole[:40], whole + b"1234567", no_samples, stray, headless, far, media.box(b"ftyp", b"isom")):
        with pytest.raises(ValueError):
            media.feature(media.read_back(data)[1])


def test_media_tables():
    payload = bytes(range(256)) * 9 * 45
    t = media.probe(media.store(payload))[0]
    assert len(t["sizes"]) == 180 and t["duration"] == len(payload) and t["codec"] == "raw "
    assert [payload.index(payload)] == [0] and len(t["keyframes"]) == 15
    assert (np.diff(t["keyframes"][:, 0]) == 12 * 576).all()
    with pytest.raises(ValueError):
        media.probe(media.store(payload)[:-1])


def brute_fingerprint(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and find(i) != find(j):
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(docs, rows, empty):
    fps = [brute_fingerprint(r[1]) for r in rows]
    comps = brute_components([r[0] for r in rows], fps)
    want = Counter((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, comps))
    assert Counter(tuple(r) for r in simhash.op8_simhash(docs).collect()) == want
    assert simhash.op8_simhash(empty).count() == 0


@pytest.mark.parametrize("most", [3, 1024])
def test_simhash_links_of_crowded_variants(spark, most):
    rng = np.random.default_rng(4)
    fps = set()
    for _ in range(12):
        centre = int(rng.integers(0, 2**63))
        for _ in range(20):
            fps.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)))
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), most=most)
    root = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    got = defaultdict(set)
    for i, x in enumerate(signed):
        got[root.get(x, x)].add(i)
    want = defaultdict(set)
    for i, c in enumerate(brute_components(list(range(len(fps))), fps)):
        want[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    assert {tuple(r) for r in simhash.components(links).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


def brute_repeats(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + length, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(r)]
        spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))) if len(r) else 0
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def brute_passages(texts, words=51):
    """Bytes of each text's words that lie in a run of `words` words which starts anywhere else too, and between two such words."""
    found = [[(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    seen = Counter(tuple(w for _, _, w in f[i : i + words]) for f in found for i in range(len(f) - words + 1))
    out = []
    for f in found:
        gone = set()
        for i in range(len(f) - words + 1):
            if seen[tuple(w for _, _, w in f[i : i + words])] > 1:
                gone.update(range(i, i + words))
        out.append(sum((f[i + 1][0] if i + 1 in gone else f[i][1]) - f[i][0] for i in gone))
    return out


def brute_groups(texts):
    """The smallest id of each document's group, by exact five-word Jaccard similarity of 0.8 or more."""
    grams = {}
    for i, t in texts.items():
        w = t.lower().split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    least = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]) and least[i] != least[j]:
                a, b = sorted((least[i], least[j]))
                least = {k: a if v == b else v for k, v in least.items()}
    return list(least.values())


def test_suffix_dedup(docs, rows, empty):
    texts = [r[1] for r in rows]
    want = Counter((r[0], *x, w) for r, x, w in zip(rows, brute_repeats(texts), brute_passages(texts)))
    assert Counter(tuple(r) for r in suffix_dedup.op4_suffix_dedup(docs).collect()) == want
    assert suffix_dedup.op4_suffix_dedup(empty).count() == 0


def test_suffix_dedup_of_planted_edges(spark):
    rng = np.random.default_rng(9)
    word = lambda n: bytes(rng.integers(97, 123, n).tolist()).decode()
    passages = [word(n) for n in (399, 400, 401, 450, 700, 2000)]
    texts = []
    for i in range(700):
        p = passages[i % 6]
        a, b = sorted(rng.integers(0, len(p) + 1, 2).tolist()) if i % 2 else (0, len(p))
        texts.append(word(int(rng.integers(0, 300))) + p[a:b] + word(int(rng.integers(0, 300))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    want = Counter((i, *x, 0) for i, x in enumerate(brute_repeats(texts)))
    assert Counter(tuple(r) for r in suffix_dedup.op4_suffix_dedup(docs).collect()) == want
    far = docs.withColumn("doc_id", F.col("doc_id") * 1_000_000_007)
    assert Counter((r[0] // 1_000_000_007, *r[1:]) for r in suffix_dedup.op4_suffix_dedup(far).collect()) == want


def test_windows_of_a_long_text_see_what_the_whole_sees():
    rng = np.random.default_rng(8)
    data = rng.integers(97, 100, 30_000).astype(np.uint8)
    data[9_000:11_000] = data[20_000:22_000]
    offsets = np.array([0, 100, 700, 26_000, 26_000, 30_000])
    whole = suffix_dedup.Scan(data, offsets)
    want = set(zip(whole.anchors.tolist(), whole.heads.tolist(), whole.reach.tolist(), (whole.low).tolist(), whole.high.tolist()))
    starts = set(whole.strings_at(np.ones(len(whole.anchors), bool)).tolist())
    got, seen = [], []
    for a, s in suffix_dedup.windows_of(data, offsets, 3000):
        c = s.core
        got += zip((s.anchors[c] + a).tolist(), s.heads[c].tolist(), s.reach[c].tolist(), (s.low[c] + a).tolist(), (s.high[c] + a).tolist())
        seen += (s.strings_at(c) + a).tolist()
    assert len(got) == len(want) and set(got) == want
    assert len(seen) == len(starts) and set(seen) == starts


def test_family_levels_stay_few():
    family = suffix_dedup.Family()
    for i in range(11):
        k = np.array([i, 100 + i // 2], np.uint64)
        family.add(suffix_dedup.Level(k, k + np.uint64(i), np.full(2, i), np.ones(2, np.int32), np.zeros(2, bool)))
    assert [r for r, _ in family.levels] == [3, 1, 0]
    key = family.matched()[0]
    assert sorted(set(key.tolist())) == [100 + i for i in range(5)]


def test_language(docs, rows, empty):
    got = crf.op6_language(docs).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 10_000}
    held = [r for r in got if r["held_out"] and r["doc_id"] in lang]
    assert held and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 4 == 2)
        if r["doc_id"] in (10_000, 10_001, 10_002, 10_004):
            assert r["lang_pred"] == "und" and r["score"] == 0
        assert 0 <= r["score"] <= 1
    assert crf.op6_language(empty).count() == 0


def test_mixed_chains_keep_words_and_labels():
    rng = np.random.default_rng(2)
    chains = [([f"{c}{i}" for i in range(n)], np.full(n, c)) for c in range(3) for n in (200, 200, 1, 3, 77) * 4]
    mixed = crf.mixed_chains(chains, rng)
    assert Counter(w for ws, _ in mixed for w in ws) == Counter(w for ws, _ in chains for w in ws)
    assert all(len(ws) == len(ls) and all(w.startswith(str(l)) for w, l in zip(ws, ls)) for ws, ls in mixed)
    assert any(len(set(ls.tolist())) > 1 for _, ls in mixed)


def test_switches_inside_a_text_are_found(docs, rows):
    tagger = crf.learn(docs)
    texts = {lang: next(r[1] for r in rows if r[2] == lang and r[1] and len(r[1].split()) > 80).split()[:80] for lang in tagger.langs if any(r[2] == lang and r[1] and len(r[1].split()) > 80 for r in rows)}
    a, b = sorted(texts)[:2]
    mixed = " ".join(texts[a][:40] + texts[b][:40] + texts[a][40:])
    ((_, _, n, switches, sure),), (many, start, stop, lang) = tagger.tag([mixed])
    assert 2 <= switches <= 6 and sure > 0.8 and many.tolist() == [switches + 1]
    right = sum(tagger.langs[l] == (b if 40 <= i < 80 else a) for x, y, l in zip(start, stop, lang) for i in range(x, y))
    assert right > 0.85 * 120
    assert np.count_nonzero(tagger.trans - np.diag(np.diag(tagger.trans))) > 0


def plain_tags(tagger, text):
    """Languages of a text's words by the recursions written out: (language, score, runs)."""
    words = [(i, w) for i, w in enumerate(text.lower().split()) if any(c.isalpha() for c in w)]
    k = len(tagger.langs)
    if not words:
        return "und", 0.0, []
    e = []
    for _, w in words:
        ids, _ = crf.word_features(["".join(c for c in w if c.isalpha())], tagger.lexicon)
        e.append(np.exp(sum(tagger.weights[j].astype(np.float32).astype(np.float64) for j in ids)))
    t, n = np.exp(tagger.trans), len(words)
    f, b = [np.exp(tagger.start) * e[0]], [np.ones(k)]
    for i in range(1, n):
        f.append((f[-1] / f[-1].sum()) @ t * e[i])
    for i in range(n - 1, 0, -1):
        x = t @ (e[i] * b[0])
        b.insert(0, x / x.sum())
    gamma = np.array([x * y / (x @ y) for x, y in zip(f, b)])
    mean, best, runs = gamma.mean(axis=0), gamma.argmax(axis=1), []
    for (i, _), l in zip(words, best):
        if runs and runs[-1][2] == l:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1, l])
    return tagger.langs[int(mean.argmax())], float(mean.max()), [(x, y, tagger.langs[l]) for x, y, l in runs]


def test_tags_against_plain_recursions(spark, docs, rows):
    tagger = crf.learn(docs)
    by_lang = {lang: next(r[1] for r in rows if r[2] == lang and r[1] and len(r[1].split()) > 60).split()[:60] for lang in ("en", "de")}
    texts = [r[1] for r in rows if r[1] is not None and len(r[1]) < 1500][:60] + ["", "12 !! 34", " ".join(by_lang["en"][:30] + ["--", "7"] + by_lang["de"][:30] + ["..."] + by_lang["en"][30:])]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(99_999, None, "x")], "doc_id long, text string, runs string").repartition(3)
    got = {r["doc_id"]: r for r in crf.identify(df, tagger, runs=True).collect()}
    for i, t in enumerate(texts):
        lang, score, runs = plain_tags(tagger, t)
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-4), i
        assert [(r["start"], r["stop"], r["lang"]) for r in got[i]["runs"]] == runs and len(runs) == (got[i]["n_switches"] + 1 if runs else 0)
    assert len(got[len(texts) - 1]["runs"]) >= 3 and got[99_999]["lang_pred"] == "und" and got[99_999]["runs"] == []


def test_the_sample_is_bounded(spark):
    rows = [(i, f"word{i % 7} " * 50, f"l{i % 9:02d}") for i in range(900)] + [(1000 + i, "text of a rare language here", "zz") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert crf.learn(df, sample=5).langs == [f"l{k:02d}" for k in range(9)] + ["zz"]
    assert crf.learn(df, sample=5, languages=4).langs == ["l00", "l01", "l02", "l03"]
    assert crf.learn(df, sample=5, most_bytes=100).langs == ["zz"]


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 5, 70, 33, 32, 64, 200])
    scores, start, trans = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    gamma, pairs = crf.posteriors(scores, lengths, start, trans)
    at, total = 0, np.zeros((3, 3))
    for n in lengths:
        e, t = np.exp(scores[at : at + n]), np.exp(trans)
        a, b = np.zeros((n, 3)), np.ones((n, 3))
        a[0] = np.exp(start) * e[0]
        for i in range(1, n):
            a[i] = (a[i - 1] @ t) * e[i]
            a[i] /= a[i].sum()
        for i in range(n - 2, -1, -1):
            b[i] = t @ (e[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        g = a * b
        assert np.allclose(gamma[at : at + n], g / g.sum(axis=1, keepdims=True))
        for i in range(1, n):
            p = a[i - 1][:, None] * t * (e[i] * b[i])[None, :]
            total += p / p.sum()
        at += n
    assert np.allclose(pairs, total)


def test_maxent(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(maxent_lm, "FREQUENT", 300)
    got = maxent_lm.op5_maxent(docs).collect()
    tokens = [[*(t or "").encode().lower().split(), None] for _, t, *_ in rows]
    held = [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 == 2 for r in rows]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted((r[0] or -1, h, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 5)) for r, t, h in zip(rows, tokens, held))
    assert sorted((r[0] or -1, r[1], r[2], r[3], r[4], round(r[5], 5)) for r in got) == want
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert maxent_lm.op5_maxent(empty).count() == 0


def test_ann(spark):
    rng = np.random.default_rng(6)
    table = [(int(r[0]), [float(x) for x in r[1]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    d = len(table[0][1])
    hot = table[7][1]
    table += [(1000 + i, hot) for i in range(60)] + [(2000, None), (2050, [0.0] * d), (2100, [float("nan")] * d), (2150, [None] * d), (2200, [1.0] * (d - 1)), (2250, [2 * x for x in hot])]
    table += [(3000 + i, rng.normal(size=d).tolist()) for i in range(80)] + [(4000, [1e200 * x for x in table[9][1]]), (4050, [1e-200 * x for x in table[11][1]])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in ann.op3_ann(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    good = {i: np.array(v, float) / max(map(abs, v)) for i, v in table if v is not None and len(v) == d and None not in v and np.isfinite(v).all() and np.any(v)}
    ids, x = list(good), np.stack(list(good.values()))
    hits = total = 0
    assert set(got) == {i for i in ids if i % 50 == 0}
    for q in got:
        s = (x * good[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((good[q] ** 2).sum()))
        want = sorted((-round(float(a), 12), i) for a, i in zip(s, ids) if i != q)[:5]
        assert len(got[q]) == 5
        for i, a in got[q]:
            assert abs(a - s[ids.index(i)]) < 1e-12
        hits += len({i for _, i in want} & {i for i, _ in got[q]})
        total += 5
    assert hits / total >= 0.97
    assert ann.op3_ann(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_ann_recall_on_the_larger_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x = np.concatenate([x + 0.0, np.random.default_rng(1).normal(size=(9000, x.shape[1])) * x.std()])
    ids = np.concatenate([ids, 100_001 + 7 * np.arange(9000)])
    got = defaultdict(set)
    for r in ann.op3_ann(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")).collect():
        got[r["query_id"]].add(r["vec_id"])
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in got:
        s = n @ n[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        hits += len(got[q] & set(ids[np.argsort(-s)[:5]].tolist()))
    assert hits >= 0.97 * 5 * len(got)


def test_ann_probes_a_part_of_the_cells(spark):
    """Recall where a query visits 16 of about 100 cells, on 50,000 vectors around 400 centres."""
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(400, 32))[rng.integers(0, 400, 50_000)] + 0.6 * rng.normal(size=(50_000, 32))).round(4)
    rows = spark.createDataFrame(list(zip(range(50_000), x.tolist())), "vec_id long, embedding array<double>").repartition(8)
    got = defaultdict(set)
    for r in ann.nearest(rows, rows.where("vec_id % 250 = 0"), cell=512).collect():
        got[r["query_id"]].add(r["vec_id"])
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 50_000, 250):
        s = n @ n[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 200 and hits >= 0.9 * 1000


def test_neighbours_through_parts_of_large_cells(spark):
    """Few cells of many vectors: each has parts, a query visits four of them in each cell, and finds what it should."""
    rng = np.random.default_rng(17)
    heads = rng.normal(size=(300, 24))
    x = (heads[rng.integers(0, 300, 12_000)] + 0.35 * rng.normal(size=(12_000, 24))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(rows, rows.where("vec_id % 60 = 0"), cell=1500, probes=8, most=8, chunk=250, parts=4).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    n = x.astype(np.float64)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 12_000, 60):
        s = n @ n[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 200 and all(len(v) == 5 for v in got.values()) and hits >= 0.9 * 1000, hits


def test_neighbours_behind_many_copies_of_the_query(spark):
    v, w, u = [1.0, 2.0, 0.5], [1.0, 1.9, 0.6], [-1.0, 0.2, 3.0]
    rows = [(50, v, 1)] * 8 + [(60, v, 1), (9, w, 1), (11, u, 1), (60, v, 1), (61, v, 1), (50, u, 1)]
    got = {}
    for r in ann.op3_ann(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 4)))
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 4)
    of_v, of_u = [(60, 1.0), (61, 1.0), (9, cos(v, w)), (11, cos(v, u))], [(11, 1.0), (9, cos(u, w)), (60, cos(u, v)), (61, cos(u, v))]
    of_u = sorted(of_u, key=lambda x: (-x[1], x[0]))
    assert sorted(got[50]) == sorted((i + 1, *x) for xs in (of_v, of_u) for i, x in enumerate(xs))


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href=/x>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><main><article><header><h1>Title &amp; more</h1></header>
    <p>One&nbsp;<b>two</b>\n three.<p>Four<br>five &lt;6&gt;</p><div class="ad">Buy!</div><ul><li>Item</li></ul><form><label>Mail</label></form>
    <section class="comments"><article><p>First comment</p></article></section></article></main><aside><p>Side</p></aside><footer>&copy; F</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\nOne two three.\nFour five <6>\nItem"
    assert html_text.main_text("") == html_text.main_text("<html><body></body></html>") == ""
    assert html_text.main_text("plain words") == "plain words"
    assert html_text.main_text("<article><p>Cut &am") == "Cut &am"
    assert html_text.main_text("<article><p>Cut</p><p cla") == "Cut"
    plain = """<body><div id=top><a href=/>Home</a> <a href=/b>Blog</a></div><div class=wrap><div class=left><p>Short aside of the site.</p></div><div class=story><h2>Head</h2>
    <div><p>A long first paragraph with many words in it, so that it weighs.</p></div><div class="share-buttons">Tweet</div><p>A long last paragraph with many words in it, too.</p></div></div><div>Copyright someone</div>"""
    assert html_text.main_text(plain) == "Head\nA long first paragraph with many words in it, so that it weighs.\nA long last paragraph with many words in it, too."
    assert html_text.main_text("<body class='nav-open'><main class='with-sidebar'><article class='post share'><p>Kept.</p></article><div class='has-ads'>Kept too.</div><article class=comment>No</article></main></body>") == "Kept.\nKept too."
    assert html_text.main_text("<div>One</div><div>Two</div>") == "One\nTwo"
    kept = "<article><p>Long enough to be prose by itself, one would say.</p><div class='share-of-market notice-period'>Two keeps.</div><div id=related-work>Three.</div></article><article>Four.</article>"
    assert html_text.main_text(kept).split("\n")[1:] == ["Two keeps.", "Three.", "Four."]
    long = "word " * 400
    assert html_text.main_text(f"<body><div><p>{long}</p><div class=ad>Buy</div><p>Short end.</p></div></body>") == f"{long.strip()}\nShort end."
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (1, "u", page)], "page_id long, url string, html string")
    assert sorted((r[0], r[3]) for r in html_text.op7_html_text(df).collect()) == [(1, 46), (1, 46), (2, 0)]


@pytest.mark.parametrize("name,stays", [
    ("post-comments", False), ("user-comments", False), ("userComments", False), ("cookie-law-info", False), ("related-posts", False), ("RelatedArticles", False), ("google-ads", False), ("top-ad-970x250", False), ("latest-news sidebar-right", False),
    ("comments-open", True), ("with-sidebar", True), ("no-ads", True), ("ad-hoc", True), ("related-work", True), ("notice-period", True), ("cookie-recipe", True), ("commentary", True), ("posts", True), ("shadow", True),
])
def test_names_of_elements_beside_the_text(name, stays):
    long = "A sentence of prose that is long enough to weigh. " * 3
    inside = f"<article><h1>Head</h1><p>{long}</p><section class='{name}'><p>Of another kind.</p></section><p>{long}</p></article>"
    want = ["Head", long.strip(), *["Of another kind."] * stays, long.strip()]
    assert html_text.main_text(f"<body>{inside}</body>").split("\n") == want
    assert html_text.main_text(f"<body><div>{inside.replace('article', 'div')}</div></body>").split("\n") == want


def test_headings_before_the_place_of_the_text():
    assert html_text.main_text("<body><h1>Title</h1><div class=x>Prose that says what there is to say here.</div></body>") == "Title\nProse that says what there is to say here."
    prose = "".join(f"<p>Sentence {i} of some prose that is long enough to weigh something.</p>" for i in range(4))
    page = f"<body><div>Imprint and more</div><hgroup><h1>Title</h1><p>Second</p></hgroup><div class=ad>Buy</div><h2>Part</h2><div class=q>{prose}</div><div>Imprint</div></body>"
    assert html_text.main_text(page).split("\n")[:3] == ["Title", "Second", "Part"] and "Imprint" not in html_text.main_text(page)
    assert html_text.main_text(f"<body><div class='layout sidebar'><main>{prose}</main></div></body>").count("\n") == 3


def test_surge_and_dive_points():
    assert html_text.regions([0, 0, 100, 3, 90, 0, 0, 0, 0, 20, 0, 0, 0]) == [(2, 5)]
    assert html_text.regions([0, 80, 0, 0, 0, 0, 70, 60, 0]) == [(6, 8)]
    assert html_text.regions([]) == html_text.regions([0, 0]) == []
    assert html_text.regions([5]) == [(0, 1)]


def test_windows_find_the_text_of_pages_without_articles(monkeypatch):
    prose = ["A first sentence of prose, long enough to weigh something.", "Another one follows it here, as sentences do in any text.", "Short.", "And a last one which closes the page with some more words."]
    side = "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(12))
    page = f"<body><div class=x1><ul>{side}</ul></div><div class=x2><h1>Head</h1>{''.join(f'<p>{p}</p>' for p in prose)}</div><div class=x3>Imprint</div></body>"
    assert html_text.main_text(page) == "\n".join(["Head", *prose])
    monkeypatch.setattr(html_text, "regions", lambda sizes: [(0, len(sizes))])
    assert html_text.main_text(page) != "\n".join(["Head", *prose])


def test_html_of_all_pages(spark):
    from html import unescape

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        body = r["html"].split("<article>")[1].split("</article>")[0]
        want = [" ".join(unescape(re.sub(r"<[^>]*>?", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert html_text.main_text(r["html"]) == "\n".join(x for x in want if x)


def test_preference(spark):
    turns = [
        (0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "x"), (0, 3, "assistant", "b"), (0, 3, "assistant", "b"), (0, 4, "user", "bye"),
        (1, 0, "user", "z"), (1, 1, "assistant", "c"), (2, 0, None, None), (3, 0, "user", "y"), (3, 5, "assistant", None), (4, 0, "user", "z"), (4, 1, "assistant", "c"),
        (5, 0, "user", "w"), (5, 1, "assistant", "c"), (None, 0, "user", "n"), (6, None, "user", "n"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = [(r["pair_id"], r["segment"], r["turn"], r["rendered"].split("\n")[1], r["in_loss"], r["start"]) for r in preference.op1_preference(df).orderBy("pair_id", "segment", "turn").collect()]
    assert got == [
        (0, "chosen", 3, "b", True, 0), (0, "chosen", 4, "bye", False, 24), (0, "prompt", 0, "q", False, 0), (0, "prompt", 1, "a", False, 19), (0, "prompt", 2, "x", False, 43),
        (0, "rejected", 3, "c", True, 0), (0, "rejected", 4, "bye", False, 24), (1, "chosen", 1, "c", True, 0), (1, "prompt", 0, "z", False, 0), (1, "rejected", 1, "b", True, 0),
        (2, "prompt", 0, "", False, 0), (3, "chosen", 5, "", True, 0), (3, "prompt", 0, "y", False, 0), (4, "prompt", 0, "z", False, 0), (4, "prompt", 1, "c", False, 19),
        (5, "prompt", 0, "w", False, 0), (5, "prompt", 1, "c", False, 19),
    ]
    assert preference.op1_preference(df.where("false")).count() == 0


def test_preference_of_pairs_given(spark):
    rows = [(7, 0, 0, "user", "q"), (7, 1, 0, "user", "q"), (7, 0, 1, "assistant", "a"), (7, 1, 1, "assistant", "b"), (8, 0, 0, "user", "q"), (9, 0, 0, "user", "u"), (9, 1, 0, "user", "u"), (9, 0, 0, "user", "v"), (9, 1, 1, "user", "v")]
    df = spark.createDataFrame(rows, "pair_id long, side int, turn long, role string, text string").withColumn("both", F.lit(1)).withColumn("cut", F.lit(1)).withColumn("segment", F.lit(1))
    got = {(r["pair_id"], r["segment"], r["turn"], r["rendered"].split("\n")[1]) for r in preference.format_pairs(df).collect()}
    assert got == {(7, "prompt", 0, "q"), (7, "chosen", 1, "a"), (7, "rejected", 1, "b"), (8, "chosen", 0, "q"), (9, "chosen", 0, "u"), (9, "chosen", 0, "v"), (9, "rejected", 0, "u"), (9, "rejected", 1, "v")}


def test_preference_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.01/conversations.parquet"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}'")
    want = sorted(map(tuple, con.execute(preference.SQL).fetchall()))
    assert sorted(tuple(r) for r in preference.op1_preference(spark.read.parquet(path)).collect()) == want


def test_clashing_columns_and_a_single_source_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    clash = docs
    for c in ("bundle", "fp", "variant", "component_id", "ids", "n_tokens", "kept", "held_out", "score", "uid", "h", "media", "n_bytes", "lang_pred", "sequence_id", "piece", "length", "key", "kind", "a", "b", "node", "root", "runs"):
        clash = clash.withColumn(c, F.lit("x"))
    for op in (bpe.op2_bpe_round_trip, suffix_dedup.op4_suffix_dedup, simhash.op8_simhash, media.op10_media, crf.op6_language):
        assert Counter(map(str, op(docs).collect())) == Counter(map(str, op(clash).collect())), op  # runs are lists
    left = suffix_dedup.remove_repeats(clash.select("doc_id", "text", "bundle", "key", "kind"))
    assert left.count() == docs.count() and left.where("bundle = 'x' and key = 'x'").count() == docs.count()


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.language(spark, docs, SF)
    ids = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert kept.columns == p.COLUMNS and kept.count() >= 0.97 * len(ids)
    near = p.near_dedup(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in near) == sorted(set(brute_groups(ids)))
    left = {r["doc_id"]: r for r in p.substring_dedup(spark, docs, SF).collect()}
    assert set(left) == set(ids)
    for (n, gone, _, digest), words, (i, t) in zip(brute_repeats(ids.values()), brute_passages(ids.values()), ids.items()):
        assert left[i]["n_chars"] == len(left[i]["text"])
        if not gone and not words:
            assert left[i]["text"] == t
        assert len(left[i]["text"].encode()) <= n - max(gone, words)
    check_sequences(p.run(spark, SF).collect(), slack=2)
