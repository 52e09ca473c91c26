"""The training-data operators against brute force, on small tables with odd rows."""

import collections
import hashlib
import html
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import _common, decontaminate, html_extract, minhash, packing, substring_dedup, suffix_dedup, syncmers, tokens, toxicity, url_rules, wavelet

WORD = re.compile("[^\x20\x09-\x0d]+")
DIR = "/root/testdata/sf0.001"
WORDS = ["alpha", "beta", "gamma", "Δelta", "éps", "zeta", "eta", "theta", "iota", "kappa"]


def _text(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 30)) for _ in range(n))


def corpus():
    """Ids with gaps, a null text, empty and blank ones, copies, near copies, shared passages, a long and a repetitive text."""
    rnd = random.Random(5)
    base, shared = [_text(rnd, rnd.randint(1, 200)) for _ in range(25)], _text(rnd, 60)
    texts = [*base, None, "", " \n\t ", "x", "a b", base[0], base[1], base[1]]
    texts += [base[2] + " tail", shared, "head " + shared + " " + base[3], base[4] + "\n" + shared, "na " * 400, _text(rnd, 3000), base[5].upper()]
    for i in range(12):
        w = base[6].split()
        w[rnd.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names the operators use inside, and nulls in them
    rows = [(i, t, None, "s", None if t is None else len(t), "grp", -1, None) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, grp string, label int, _key string").repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """A null id and repeated rows."""
    return spark.createDataFrame([(None, "null id text " * 20), (1, "same"), (1, "same"), (2, "one two three " * 15), (2, "other")], "doc_id long, text string")


def by_id(df):
    out = {r.doc_id: r for r in df.collect()}
    return out


# --- op9, op3 ------------------------------------------------------------------------------------


def test_substring_dedup_against_brute_force(docs):
    width = 20
    got = by_id(substring_dedup.remove_repeats(docs, width))
    words = {i: WORD.findall(t or "") for i, t in corpus()}
    seen = collections.Counter(tuple(w[k : k + width]) for w in words.values() for k in range(len(w) - width + 1))
    assert len(got) == len(words)
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone |= set(range(k, k + width))
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))


@pytest.mark.parametrize(("many", "piece"), [(False, 1 << 20), (True, 1 << 20), (False, 300)])
def test_suffix_dedup_against_brute_force(docs, spark, monkeypatch, many, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)  # long texts are hashed in pieces
    length, rows = 70, corpus()
    if many:  # one line in very many contexts: its grams fill several buckets, so runs go on across boundaries
        rnd, line = random.Random(4), _text(random.Random(9), 16)
        rows = [*rows, *((1000 + i, f"{_text(rnd, 6)} {line} {_text(rnd, 6)}") for i in range(600))]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = by_id(suffix_dedup.remove_repeats(docs, length))
    seen = set()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(b[k : k + length])
        assert got[i].n_bytes == len(b) and bytes(got[i].kept) == bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert sum(s.end - s.start for s in got[i].spans) == sum(gone)


@pytest.mark.parametrize("kinds", [2, 3, 1000])
def test_multikey_quicksort(kinds):
    rnd = np.random.default_rng(2)
    keys, own = rnd.integers(0, kinds, (700, 4)).astype(np.uint64), np.sort(rnd.integers(0, 5, 700))
    order, group = suffix_dedup.multikey_quicksort(lambda item, j: keys[item, j], 700, 4, own)
    rows = [(g, *r) for g, r in zip(own[order].tolist(), keys[order].tolist(), strict=True)]
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(700))
    assert [a != b for a, b in zip(rows, rows[1:], strict=False)] == (np.diff(group) > 0).tolist()
    assert suffix_dedup.multikey_quicksort(lambda item, j: keys[item, j], 0, 4, own[:0])[0].tolist() == []


def test_cut_text_is_whole_characters(docs):
    out = suffix_dedup.without_repeats(docs, 70)
    assert out.columns == docs.columns
    got = by_id(out)
    assert len(got) == len(corpus()) and all(r.n_chars == len(r.text) for r in got.values())


# --- op10 ----------------------------------------------------------------------------------------


def _components(width):
    sets = {}
    for i, t in corpus():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("stars", [1, 0])
def test_near_duplicates_against_brute_force(docs, monkeypatch, stars):
    monkeypatch.setattr(minhash, "STARS", stars)
    got = by_id(minhash.near_duplicates(docs, 4))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == _components(4)
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


@pytest.mark.parametrize("block", [512, 3])
def test_large_bucket_of_pairs_that_share_no_other_band(spark, monkeypatch, block):
    real = minhash._signatures

    def one_band(width, permutations):
        run = real(width, permutations)

        def lone(batches):
            import pyarrow as pa

            for batch in run(batches):
                bands = [[7] + [-(100 * i + k + 1) for k in range(24)] for i in batch.column(0).to_pylist()]
                yield batch.set_column(3, "bands", pa.array(bands, pa.list_(pa.int64())))

        return lone

    monkeypatch.setattr(minhash, "_signatures", one_band)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = [(2 * i + j, " ".join(f"w{i}x{k}" for k in range(60 + j))) for i in range(20) for j in (0, 1)]
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == {i: i - i % 2 for i, _ in rows}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    got = {r.node: r.label for r in minhash.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99}


# --- op5, op1 ------------------------------------------------------------------------------------

ODD_TEXTS = ["", " ", "a  b\n\nc \t", "it's we'll DON'T", "x\x1cy \x1f", "é́ ê b c", "<|endoftext|> a<|endoftext|> b <|startoftext|>x", "12 345 ~~ ##a", "ΣΑΣ ΣΑΣ. İi", "😀 ok\r\n\r\n", "日本 語", "a" * 300]


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_encoder_equals_the_tokenizer(name, drops):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    texts = ODD_TEXTS + [t or "" for _, t in corpus()] + [t + u for t in ODD_TEXTS for u in ODD_TEXTS]
    for t, ids in zip(texts, tokens.Encoder(path, drops).ids(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_wavelet_matrix():
    x = np.random.default_rng(1).integers(0, 50257, 3000).astype(np.uint16)
    x[::7] = 11
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(x).to_bytes())
    assert (w.ids() == x).all() and all(w.access(i) == x[i] for i in range(0, 3000, 53))
    for t in (11, int(x[5]), 7):
        at = np.flatnonzero(x == t)
        assert w.count(t) == len(at) and w.count(t, 100, 2000) == ((at >= 100) & (at < 2000)).sum()
        assert [w.select(t, k) for k in range(0, len(at), 17)] == at[::17].tolist()
        with pytest.raises(IndexError):
            w.select(t, len(at))
    assert wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(x[:0]).to_bytes()).ids().tolist() == []


def test_token_files_round_trip(docs, odd, spark, monkeypatch, tmp_path):
    monkeypatch.setattr(wavelet, "SHARD", 700)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wavelet.write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"))
    got, at = by_id(wavelet.read_documents(spark, str(tmp_path / "t"))), 0
    for i, t in corpus():
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    wavelet.write_tokens(odd, str(tmp_path / "o"), public_tokenizers.path("byte_bpe_50k.json"))
    rows = wavelet.read_documents(spark, str(tmp_path / "o")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 2] and rows[0].start == 0


def test_packing(docs, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, window = Tokenizer.from_file(path), 256
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in corpus()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack_documents(docs, path, window=window).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        assert sum(n for _, n in pieces[i]) == len(x) and all(a + n == b for (a, n), (b, _) in zip(sorted(pieces[i]), sorted(pieces[i])[1:], strict=False))
    for s in sequences.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(s), sorted(s)[1:], strict=False)) and min(s)[0] == 0
        total = sum(n for _, n in s)
        assert total <= window and total & (total - 1) == 0
    assert sum(r.length for r in packing.pack_documents(odd, path).collect() if r.doc_id is None) == len(plain.encode("null id text " * 20, add_special_tokens=False).ids) + 1


def test_bm25_prefers_shared_rare_terms():
    pieces = [np.array(p, np.uint16) for p in ([1, 2, 3], [9, 9, 8], [1, 2, 4], [7, 5, 6])]
    df = np.bincount(np.concatenate([np.unique(p) for p in pieces]), minlength=10)
    terms = [b"".join(x.astype("<u2").tobytes() for x in np.unique(p, return_counts=True)) for p in pieces]
    shard = packing.Shard(terms, np.log1p((4 - df + 0.5) / (df + 0.5)), 3.0)
    shard.unused[0] = False
    assert next(shard.neighbours(0)) == 2


# --- op4 -----------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rnd = random.Random(8)
    items = [(k, _text(rnd, 12) + ".") for k in range(6)] + [(6, "tiny"), (7, None)]
    plain = decontaminate.plain
    edited = items[1][1].replace("a", "e", 1)
    texts = [_text(rnd, 30) + " " + items[0][1].upper() + "\n" + _text(rnd, 5), "x " + edited, items[2][1][:20], None, "", items[3][1] + " " + items[3][1], _text(rnd, 300)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(docs, bench).collect()

    def distance(a, b):
        row = [0] * (len(b) + 1)
        for i, c in enumerate(a):
            new = [i + 1]
            for j, d in enumerate(b):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    want = {(i, k) for i, t in enumerate(texts) for k, x in items if x and len(plain(x)) >= decontaminate.Q and distance(plain(x), plain(t or "")) <= decontaminate.budget(len(plain(x)))}
    assert {(r.doc_id, r.item_id) for r in got} == want >= {(0, 0), (1, 1), (5, 3)}
    assert all(plain(texts[r.doc_id][r.start : r.end]) == plain(dict(items)[r.item_id]) for r in got if r.edits == 0)
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()} == set(range(7)) - {i for i, _ in want}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


# --- op6 -----------------------------------------------------------------------------------------


def _print_of(hashes, text):
    """Brute force over one text: hashes gives the engine's own hash of words, of two words, of five, of a pair of anchors."""
    w = [hashes(x) for x in text.split()]
    pick = [i for i in range(len(w) - 4) if min((g := [hashes(*w[j : j + 2]) for j in range(i, i + 4)])[0], g[3]) <= min(g[1:3])]
    anchors = [(hashes(*w[i : i + 5]), i) for i in pick]
    if not anchors:
        return {("all", tuple(w))} if w else set()
    if len(anchors) == 1:
        return {anchors[0][0]}
    return {(a, b, j - i) for (a, i), (b, j) in zip(anchors, anchors[1:], strict=False)}


def test_fingerprints_against_brute_force(docs, spark):
    rows = [(i, t or "") for i, t in corpus()]
    got = by_id(syncmers.compare_edited(docs))
    edited = []
    for k, (_, t) in enumerate(rows):
        q = len(t) // 4
        edited.append(t[: len(t) - q] + rows[(k + 1) % len(rows)][1][:q])
    seen = sorted({x for _, t in [*rows, *enumerate(edited)] for x in t.split()})
    word = dict(zip(seen, [r.h for r in spark.createDataFrame([(i, x) for i, x in enumerate(seen)], "i int, x string").select("i", F.xxhash64("x").alias("h")).orderBy("i").collect()], strict=True))
    runs = {n: sorted({tuple(word[x] for x in w[i : i + n]) for _, t in [*rows, *enumerate(edited)] for w in [t.split()] for i in range(len(w) - n + 1)}) for n in (2, 5)}
    table = {}
    for n, found in runs.items():
        df = spark.createDataFrame([(k, *r) for k, r in enumerate(found)], ", ".join(["k int", *(f"c{i} long" for i in range(n))]))
        hashed = {r.k: r.h for r in df.select("k", F.xxhash64(*[f"c{i}" for i in range(n)]).alias("h")).collect()}
        table |= {r: hashed[k] for k, r in enumerate(found)}
    hashes = lambda *x: word[x[0]] if len(x) == 1 else table[x]
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    own, other = [_print_of(hashes, t) for _, t in rows], [_print_of(hashes, t) for t in edited]
    strings = {}
    for k, (i, t) in enumerate(rows):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited[k].encode()).hexdigest())
        assert (r.near_edited, r.near_next) == pytest.approx((alike(own[k], other[k]), alike(own[k], own[(k + 1) % len(rows)])))
        assert len(r.fingerprint.split(".")) == max(1, len(own[k]))
        assert strings.setdefault(frozenset(own[k]), r.fingerprint) == r.fingerprint
    assert len(set(strings.values())) == len(strings)


def test_syncmers_are_closed_and_context_free(spark):
    words = [f"w{(i * i) % 37}" for i in range(120)]
    rows = [(1, " ".join(words)), (2, "other start " + " ".join(words[40:80])), (3, "one two"), (4, None)]
    got = by_id(syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")))
    one = {(s.pos, s.hash) for s in got[1].syncmers}
    two = {(s.pos - 2 + 40, s.hash) for s in got[2].syncmers if s.pos >= 2}
    assert two == {(p, h) for p, h in one if 40 <= p <= 75} and two
    assert len(got[3].fingerprint) == 1 and got[4].fingerprint == []


def test_places_count(spark):
    """The same anchors at other distances are no match; a passage that moves as a whole is."""
    rnd = random.Random(1)
    parts = [_text(rnd, 5) for _ in range(40)]
    gaps = lambda seed: " ".join(x + " " + _text(random.Random(seed + i), 1 + i % 3 if seed else 2) for i, x in enumerate(parts))
    rows = [(1, gaps(0)), (2, _text(rnd, 33) + " " + gaps(0)), (3, gaps(7))]
    got = by_id(syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")))
    one, two, three = (set(got[i].fingerprint) for i in (1, 2, 3))
    assert len(one & two) >= len(one) - 1 and not one & three
    assert {s.hash for s in got[1].syncmers} & {s.hash for s in got[3].syncmers}


# --- op2, op7, op8 -------------------------------------------------------------------------------


def test_given_rules_and_mined_rules(spark):
    urls = ["http://A.example.COM/en/7?x", "https://example.com/en/1#y", "ftp://x.net/de/8", "nothing", None, "http://notcom/en/", "http://b.example.net/de/80", "http://h.org/es/?q", "http://a.b.org", "://?", "http://x.com/en/\n"]
    urls += [f"http://s{k}.spam.info/buy/{k}" for k in range(60)] + [f"http://s{k}.good.info/read/{k}" for k in range(60)]
    pages = spark.createDataFrame([(i, u, 1.0) for i, u in enumerate(urls)], "page_id long, url string, confidence double")
    labels = spark.createDataFrame([(i, 0 if u and "spam" in u else 1) for i, u in enumerate(urls)] + [(None, 0), (3, None)], "doc_id long, quality int")
    got = {r.page_id: r for r in url_rules.judge_urls(pages, labels).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(11)] == [
        ("a.example.com", "/en/7", "example.com/en/7", "allow"), ("example.com", "/en/1", "com/en/", "block"), ("x.net", "/de/8", "net/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("notcom", "/en/", None, "allow"),
        ("b.example.net", "/de/80", "example.net/de/8", "allow"), ("h.org", "/es/", "org/es/", "block"), ("a.b.org", "", None, "allow"), ("", "", None, "allow"), ("x.com", "/en/\n", "com/en/", "block"),
    ]
    assert all(got[11 + k].verdict == "block" and got[71 + k].verdict == "allow" for k in range(60))
    assert {r.verdict for r in url_rules.judge_urls(pages.limit(0), labels).collect()} == set()
    assert url_rules.judge_urls(pages, labels.limit(0)).count() == len(urls)


def test_rule_of_four_tokens(spark):
    words = ("alpha", "beta", "gamma", "delta")
    urls = [f"http://x.info/{'/'.join(words)}/{k}" for k in range(40)] + [f"http://x.info/{'/'.join(w for w in words if w != out)}/{k}" for out in words for k in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 40 else 1) for i in range(len(urls))], "doc_id long, quality int")
    assert all((r.verdict == "block") == (r.page_id < 40) for r in url_rules.judge_urls(pages, labels).collect())


def test_shared_tokens_do_not_multiply(spark):
    """25 words that all URLs of a kind share are one item; a URL that has any of them, and the rest of a rule, is judged."""
    words = "/".join(f"{a}{b}w" for a in "abcde" for b in "vwxyz")
    urls = [f"http://x.info/{words}/buy/{k}" for k in range(60)] + [f"http://x.info/{words}/read/{k}" for k in range(60)] + [f"http://x.info/other/buy/{k}" for k in range(60)] + ["http://y.info/avw/buy/"]
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(180)], "doc_id long, quality int")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), labels).collect()}
    assert all((got[i] == "block") == (i < 60) for i in range(180)) and got[180] == "block"


def test_mined_rules_against_brute_force(spark):
    """All combinations of a random table, and how the rules that they give do on rows that taught nothing."""
    rnd, kinds = random.Random(6), ["shop", "blog", "pills", "casino", "news", "wiki"]
    rows = []
    for i in range(900):
        own = sorted(rnd.sample(kinds, rnd.randint(1, 3)))
        bad = rnd.random() < (0.9 if {"shop", "pills"} <= set(own) or "casino" in own else 0.1)
        rows.append((i, f"http://h{i}.example/{'/'.join(own)}/{i}", bad, frozenset(f"p:{x}" for x in own) | {"h:example"}))
    teach, test = rows[:600], rows[600:]
    least, confident = 20, 0.6
    rules = {}
    for n in range(1, 4):
        for c in itertools.combinations(sorted({t for *_, s in teach for t in s} - {"h:example"}), n):
            hit = [bad for *_, bad, s in teach if set(c) <= s]
            if sum(hit) >= least and sum(hit) / len(hit) >= confident:
                rules[frozenset(c)] = sum(hit) / len(hit)
    want = {r[0]: "block" if any(c <= r[3] for c in rules) else "allow" for r in rows}
    pages, labels = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string"), spark.createDataFrame([(r[0], 1 - r[2]) for r in teach], "doc_id long, quality int")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, labels, min_urls=least).collect()}
    assert got == want and rules
    blocked = [r for r in test if got[r[0]] == "block"]
    assert sum(r[2] for r in blocked) > 0.8 * len(blocked) and sum(r[2] for r in blocked) > 0.6 * sum(r[2] for r in test)


def test_main_text_of_odd_markup():
    page = '<body><header>H</header><div id="cookie-notice">c</div><main><article><header><h1>T &amp; x</h1></header><p>A<b>b</b> c<br>d<p>E <!-- no --><ul><li>1<li>2</ul><aside>no</aside><form>f</form><section class="comments"><p>bad</section></article></main><footer>x'
    assert _lone(page) == "T & x\n\nAb c d\n\nE\n\n1\n\n2"


def _lone(page):
    own, groups = html_extract.Skeleton.of(html_extract.Tree.of(page))
    return html_extract.main_text(groups[html_extract.content_root(own, own.sizes)], set())


def test_markup_that_breaks_parsers_and_names_that_mislead():
    assert _lone("<p>a<![foo bar]>b" + "<i>" * 3000 + "deep") == "abdeep" and _lone("<![") in ("", "<![") and _lone("") == ""
    for page in ('<body class="has-sidebar"><article><p>x y</article>', '<article><p class="related">x y</p></article>', '<div id="social-history"><p>x y</p></div>', '<body class="ad"><p>x y', '<article class="notice"><p>x y'):
        assert _lone(page) == "x y", page
    assert _lone('<article><p>x</p><div class="ad-box">no</div><div class="cookie-notice">no</div><section id="comments"><p>no</p></section><div class="list">y</div></article>') == "x\n\ny"
    deep, other = (html_extract.Skeleton.of(html_extract.Tree.of("<div>" * 1500 + x))[0] for x in ("one", "two"))
    assert len(html_extract.match(html_extract.Skeleton.from_json(deep.to_json()), other)) == 1501


def test_simple_tree_matching_against_brute_force():
    rnd = random.Random(3)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in rnd.choices(["b", "i", "u", "s"], k=rnd.randint(0, 3))) if depth else ""

    def size(a, b, x, y):
        if a.labels[x] != b.labels[y]:
            return 0
        rows, columns = a.kids[x], b.kids[y]
        m = [[0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
        for i, r in enumerate(rows):
            for j, c in enumerate(columns):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + size(a, b, r, c))
        return 1 + m[-1][-1]

    for _ in range(60):
        a, b = (html_extract.Skeleton.of(html_extract.Tree.of(tree(4)))[0] for _ in range(2))
        pairs = html_extract.match(a, b)
        assert len(pairs) == size(a, b, 0, 0) and all(a.labels[x] == b.labels[y] for x, y in pairs)
        assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)


def test_the_wrapper_finds_the_content(spark, monkeypatch):
    """No element says what it is: constant nodes and where the varying text lies decide."""
    page = "<body><div class=a>Our site</div><div class=b><div class=c><a href=x>Link {0} to somewhere else on this site</a></div><div class=d>Tip {0}</div><div class=e><h1>Title {0}</h1><p>Story {0} {1}</p><p>Same on every page</p><div class=f><p>More {0} {1}</p></div></div></div><div class=g>Address of the house, a long line that never changes at all</div>"
    rows = [(k, f"http://plain.example/{k}", page.format(k, f"some longer words of page {k} " * 6)) for k in range(9)] + [(9, "http://plain.example/short", page.format(9, ""))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, nodes int")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    story = lambda k, w: f"Title {k}\n\n" + " ".join(f"Story {k} {w}".split()) + "\n\nSame on every page\n\n" + " ".join(f"More {k} {w}".split())
    assert got == {k: story(k, f"some longer words of page {k} " * 6) for k in range(9)} | {9: story(9, "")}
    monkeypatch.setattr(html_extract, "MIN_PAGES", 10**6)  # without a wrapper the short page can't be told
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()}[9] != got[9]


def test_wrapper_drops_what_is_constant_on_a_host(spark):
    page = "<body><div class=top>Welcome to our site</div><article><h1>Title {0}</h1><p>Story {0} &lt;b&gt;</p><div class=box>Follow us daily</div></article>"
    rows = [(k, f"http://one.example/{k}", page.format(k)) for k in range(8)] + [(20, "http://lone.example/", page.format(20)), (21, None, None), (22, "x", "")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{k: f"Title {k}\n\nStory {k} <b>" for k in range(8)}, 20: "Title 20\n\nStory 20 <b>\n\nFollow us daily", 21: "", 22: ""}


def test_copies_of_a_page_are_one_vote(spark):
    page = "<body><div class=top>Welcome</div><article><h1>Title {0}</h1><p>Story {0}</p>{1}</article>"
    quote = "<blockquote>Said once</blockquote>"
    rows = [(k, f"http://copies.example/{k}", page.format(1, "")) for k in range(9)]
    rows += [(10 + k, f"http://quote.example/{k}", page.format(1, quote)) for k in range(5)] + [(20 + k, f"http://quote.example/{k}", page.format(k, "")) for k in range(12)]
    # different pages that share a quote, on a host where few pages have one
    rows += [(50 + k, f"http://few.example/{k}", page.format(k, quote if k < 4 else "")) for k in range(20)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].endswith("Title 1\n\nStory 1") for k in range(9))
    assert all(got[10 + k] == "Title 1\n\nStory 1\n\nSaid once" for k in range(5))
    assert all(got[50 + k].endswith("Said once") == (k < 4) for k in range(20))


def test_extraction_over_the_given_pages(spark):
    got = {r.page_id: r.text for r in html_extract.op7(spark, DIR).collect()}
    for r in spark.read.parquet(f"{DIR}/pages.parquet").collect():
        article = re.search("<article>(.*?)</article>", r.html or "", re.S)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article[1])] if article else []
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_toxicity_held_out(spark):
    rnd = random.Random(3)
    calm = lambda n: " ".join("".join(rnd.choice("bcdlmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 3))) for _ in range(n))
    rows, labels = [], []
    for i in range(1500):
        bad, text = rnd.random() < 0.3, calm(rnd.randint(10, 60)).split()
        if bad:
            for _ in range(3):
                text[rnd.randrange(len(text))] = "wazzock" + rnd.choice(["", "s", "ed", "ing", "x"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(9000, "wazzockery " + calm(8)), (9001, None), (9002, "")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (9001, None)], "doc_id long, toxic int")
    got = by_id(toxicity.score_toxicity(docs, marks.where(~toxicity.held_out())))
    test = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i].score >= 0.3) == bool(dict(labels)[i]) for i in test)
    assert right / len(test) > 0.92 and got[9000].score > 0.3 and got[9001].score == got[9002].score
    assert {r.score for r in toxicity.score_toxicity(docs, marks.limit(0)).collect()} == {0.0}


# --- shared rules --------------------------------------------------------------------------------


def test_null_ids_and_repeated_rows(odd):
    for out in (substring_dedup.remove_repeats(odd), suffix_dedup.remove_repeats(odd), minhash.near_duplicates(odd), syncmers.compare_edited(odd), syncmers.fingerprints(odd)):
        assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 1, 2, 2, None]
    # each row is judged by its own text
    assert sorted((r.doc_id, r.text) for r in minhash.drop_near_duplicates(odd.where("doc_id is not null")).collect()) == [(1, "same"), (2, "one two three " * 15), (2, "other")]
    cut = sorted(((r.doc_id, len(r.text)) for r in suffix_dedup.without_repeats(odd.where("doc_id = 2 or doc_id is null"), 70).collect()), key=str)
    assert cut == [(2, 14), (2, 5), (None, 13)]


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    for out in (substring_dedup.remove_repeats(none), suffix_dedup.remove_repeats(none), suffix_dedup.without_repeats(none), minhash.near_duplicates(none), minhash.drop_near_duplicates(none), syncmers.compare_edited(none), packing.pack_documents(none, public_tokenizers.path("word_bpe_49k.json"))):
        assert out.collect() == []
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_empty_tables_of_the_others(docs, spark, tmp_path):
    none, marks = docs.limit(0), spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "some item of many plain words here")], "item_id long, text string")
    assert decontaminate.find_leaks(none, bench).collect() == decontaminate.drop_leaks(none, bench).collect() == []
    assert decontaminate.drop_leaks(docs, bench.limit(0)).count() == docs.count()
    assert toxicity.score_toxicity(none, marks).collect() == toxicity.drop_toxic(none, marks).collect() == []
    wavelet.write_tokens(none, str(tmp_path / "none"), public_tokenizers.path("byte_bpe_50k.json"))
    assert wavelet.read_documents(spark, str(tmp_path / "none")).collect() == []
    urls = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_rules.judge_urls(urls, spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_columns_that_clash_pass_through(spark):
    rows = [(i, f"word{i} calm text " * 5, 0.5, [i], {"a": i}) for i in range(30)] + [(None, "wazz " * 9, None, None, None), (None, "calm text " * 9, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, words array<int>, extra map<string,int>")
    marks = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(30)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(df, marks, threshold=2.0)
    assert kept.columns == df.columns and kept.count() == 32 and {r.extra["a"] for r in kept.collect() if r.extra} == set(range(30))
    near = minhash.drop_near_duplicates(df)
    assert near.columns == df.columns and near.count() == 32
    assert decontaminate.drop_leaks(df, spark.createDataFrame([(1, "word3 calm text word3 calm text")], "item_id long, text string")).count() == 31


def test_alignment_in_a_band_against_brute_force():
    rnd = random.Random(12)
    for _ in range(300):
        item = "".join(rnd.choice("ab") for _ in range(rnd.randint(4, 20)))
        text = list(item)
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(text) + 1)
            text[k : k + rnd.randint(0, 1)] = rnd.choice(["", "c", "a"])
        text = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 3))) + "".join(text) + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 3)))
        best = list(range(len(text) + 1))
        best = [0] * (len(text) + 1)
        for i, c in enumerate(item):
            new = [i + 1]
            for j, d in enumerate(text):
                new.append(min(best[j] + (c != d), best[j + 1] + 1, new[j] + 1))
            best = new
        for most in (0, 1, 3):
            found = decontaminate.align(item, text, most)
            # all of the text lies within the band if it is at most `most` longer on either side
            if min(best) <= most and len(text) <= len(item) + 2 * most:
                assert found and found[0] == min(best), (item, text, most)
            if found:
                assert min(best) <= found[0] <= most or item in text


def test_pack_round_trip():
    a = [np.arange(5, dtype=np.int64), np.zeros(0, np.uint64), np.array([3], np.uint8)]
    b = _common.unpack(_common.pack(*a))
    assert all(x.dtype == y.dtype and (x == y).all() for x, y in zip(a, b, strict=True))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bench = dict(duckdb.sql(f"select item_id, text from '{DIR}/benchmark.parquet'").fetchall())
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = _common.written(stage(spark, before, DIR))
        assert after.columns == docs.columns
        a, b = by_id(before), by_id(after)
        assert set(b) <= set(a)
        if name == "toxicity":
            scores = by_id(toxicity.score_toxicity(before, spark.read.parquet(f"{DIR}/labels.parquet").where(~toxicity.held_out())))
            assert set(b) == {i for i in a if scores[i].score < 0.3}
        elif name == "near_duplicates":
            assert set(b) == {r.doc_id for r in minhash.near_duplicates(before).where("kept").collect()}
        elif name == "repeated_text":
            assert set(a) == set(b) and all(r.n_chars == len(r.text) <= a[i].n_chars for i, r in b.items())
        else:
            leaked = {i for i, r in a.items() if any(decontaminate.plain(t) in decontaminate.plain(r.text) for t in bench.values())}
            assert leaked and not leaked & set(b)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, DIR)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(by_id(before))
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
