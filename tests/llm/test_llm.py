import base64
import hashlib
import io
import math
import os
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from tallyframe.llm import bpe, langid, license_scan, mixing, near_dedup, quality, substring_dedup, suffix_dedup, token_output, topk

COLS = "doc_id long, text string, lang string, source string, n_chars long, _d string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(rng.choice(["Aa", "bö", "c", "dd", "e", "ff", "g", "hh"], n))
    base = word(60)
    texts = [base, base, base + " x y", word(40) + " " + base, None, "", "  \n", "one two", "ONE two", "z" * 3000, "é" * 400, word(300), word(20000), base + "\n" + base]
    rows = [(i, t, "en" if i % 2 else None, [None, "a", "b"][i % 3], 0, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, "no id", None, None, 0, "x")], COLS)


@pytest.fixture(scope="module")
def unique(docs):
    return docs.where("doc_id is not null").dropDuplicates(["doc_id"])


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_bpe(docs, spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert got.count() == docs.count()
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got.collect():
        assert r.ids == enc.encode_ordinary(want[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_bpe_registered_path(docs):
    got = bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=False)
    whole = {(r.doc_id, r.decoded_sha256): r for r in bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert "ids" not in got.columns and got.count() == docs.count()
    for r in got.collect():
        ids = whole[r.doc_id, r.decoded_sha256].ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_bpe_many_at_once_equals_one_by_one():
    b, rng = bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), np.random.default_rng(2)
    pieces = ["".join(rng.choice(list("aethnoéß ñ\u4e2d"), int(n))) for n in rng.integers(1, 20, 400)]
    for width in (2, 4, 8, 16, 32, 64):
        group = [x for x in (p.encode() for p in pieces) if width // 2 < len(x) <= width]
        assert [x.tolist() for x in b.merge_many(group, width)] == [b.merge(x) for x in group] if group else True
    long = " ".join(pieces * 30).encode()
    assert b.decode(b.merge(long)) == long


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = token_output.token_files(docs, P.path("word_bpe_49k.json")).collect()
    want = Counter((r.doc_id, crc([*tok.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in docs.collect())
    assert Counter((r.doc_id, r.ids_crc32) for r in rows) == want
    at = 0
    ordered = sorted(rows, key=lambda r: r.start)
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    assert token_output.token_files(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_words_one_by_one_equal_whole_texts():
    w, rng = token_output.WordEncoder(P.path("word_bpe_49k.json")), np.random.default_rng(4)
    odd = ["'s \u03a3\u03b1\u03c2 <|endoftext|>x I'LL it's 12 3.5!!'s J\u030c I\u0307", "", "a" * 500]
    letters = list("aZ'sTrReEvVmMlLdD! 019-<|>\x1c\x00\t\u0301\x85\xa0\u3000\u017f\u03a3\u03c3\u0130\u030c")
    texts = odd + ["".join(rng.choice(letters, 60)) for _ in range(500)]
    whole = [e.ids for e in w.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert w.by_word and [np.frombuffer(x, "<u4").tolist() for x in w.encode(texts)] == whole


def test_parts_by_the_model_equal_the_library(monkeypatch):
    """Words of all kinds come out as by the whole library, which only sees the odd ones."""
    rng = np.random.default_rng(13)
    letters = [*"aZé'sIİßΣςñ0½٣#%_中한ﬁ", "e\u0301", "\u0301", "\u200d", "\ufeff", "😀", "'LL", "'re"]
    words = ["".join(rng.choice(letters, int(n))) for n in rng.integers(1, 9, 4000)]
    odd = ["a\x01b", "\u00a0x", "x\u3000y", "a\u2003", "\u180ez", "<|endoftext|>", "é<|", "\x7f", "\x1cq", "\x85", "é\x00"]
    encoder = token_output.WordEncoder(P.path("word_bpe_49k.json"))
    want, seen, library = encoder._encoded([*words, *odd]), [], encoder._encoded
    monkeypatch.setattr(encoder, "_encoded", lambda texts: seen.extend(texts) or library(texts))
    assert encoder.encode([*words, *odd]) == want
    assert encoder.encode([" ".join(words), "\n".join(odd)]) == library([" ".join(words), "\n".join(odd)])
    assert len(seen) <= len(odd)


def test_frames():
    out = io.BytesIO()
    w = token_output.FrameWriter(out, 64)
    for i in range(50):
        w.add(i, np.arange(i, dtype="<u4").tobytes())
    w.close()
    data = out.getvalue()
    reader = token_output.FrameReader(io.BytesIO(data), len(data))
    assert reader.document(33).tolist() == list(range(33)) and len(reader.frames) > 3
    broken = bytearray(data)
    broken[len(data) - 9 - 12 * len(reader.frames) + 8] ^= 1  # the stored checksum of the first frame
    with pytest.raises(ValueError, match="frame 0 is damaged"):
        list(token_output.FrameReader(io.BytesIO(bytes(broken)), len(data)))


BIG = 9007199254740993


def test_ids_beyond_doubles_stay_exact(spark):
    df = spark.createDataFrame([(BIG, "a b c", None), (None, "a b c d", None)], "doc_id long, text string, lang string")
    made = [token_output.token_files(df, P.path("word_bpe_49k.json")), bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)]
    for got in made:
        assert {r.doc_id for r in got.collect()} == {BIG, None}


def test_mixing(docs):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert sum(r.taken for r in mine) == int(mine[0].target)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_quality(docs, spark):
    labels = spark.createDataFrame([(None, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for r in quality.quality(docs, labels).collect():
        text = next(x.text for x in docs.collect() if x.doc_id == r.doc_id) or ""
        w = WORDS.findall(text)
        n = Counter(zip(w, w[1:], w[2:]))
        hit = {i + j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.n_repeat_words, r.word_chars, r.n_dup_lines) == (len(w), len(hit), len("".join(w)), len(lines) - len(set(lines)))
        assert r.kept == (not r.base_failed)


def test_quality_certifies_a_cutoff(spark):
    good = " ".join(f"w{i}" for i in range(60))
    bad = " ".join(f"##{i}" for i in range(60))
    d = spark.range(8000).selectExpr("id doc_id", f"if(id % 4 = 0, '{bad}', '{good}') text", "'en' lang")
    labels = d.selectExpr("doc_id", "if(doc_id % 4 = 0, 0, 1) quality", "0 toxic")
    got = quality.quality(d, labels)
    assert got.where("kept").count() == 6000 and got.where("kept and doc_id % 4 = 0").count() == 0


def test_quality_certifies_small_strata(spark):
    """Each stratum has 250 good documents, of which the strictest length cutoff alone would reject a fifth in `long`."""
    good, bad, lengthy = (" ".join(f"{w}{i}" for i in range(60)) for w in ("w", "##", "abcdefg"))
    text = f"case when id % 6 = 0 then '{bad}' when id % 5 = 0 and lang = 'long' then '{lengthy}' else '{good}' end text"
    d = spark.range(1200).selectExpr("id doc_id", "if(id < 300, 'en', if(id < 600, 'de', if(id < 900, 'fr', 'long'))) lang").selectExpr("doc_id", text.replace("id", "doc_id"), "lang")
    labels = d.selectExpr("doc_id", "if(doc_id % 6 = 0, 0, 1) quality", "0 toxic")
    got = quality.quality(d, labels)
    assert got.where("kept and doc_id % 6 = 0").count() == 0 and got.where("kept").count() == 1000


def test_license(spark):
    texts = ["Under  the MIT License. cc-by-nc", "a; under the mit licence", "nothing", None, "undr the mit license apache license version 2", "", "x" * 200_000]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(BIG, texts[1], 0), (None, texts[1], 0), (None, texts[1], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    every = license_scan.scan(df).collect()
    got = {r.doc_id: r for r in every}
    assert len(every) == len(rows) and set(got) == {*range(7), BIG, None} and license_scan.scan(df.limit(0)).count() == 0
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels, got[0].score) == (2, 0, 4, "cc-by-nc,mit", 1.0)
    for i in (1, BIG, None):
        assert (got[i].n_base, got[i].labels, [tuple(s) for s in got[i].spans]) == (0, "mit", [(3, 24, 1, "mit")])
    assert (got[2].labels, got[2].score, got[3].n_words) == ("", 0.0, 0)
    assert got[4].labels == "apache-2,mit"


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("under the mpl license", {"mpl"}),
        ("under the gpl license", {"gpl"}),
        ("under the exit license", set()),
        ("under the unit license", set()),
        ("thunder the mit licensee", set()),
        ("undr the mit licence", {"mit"}),
        ("apache license version 1", set()),
        ("apache licence versoin 2", set()),
        ("apache licence verson 2", {"apache-2"}),
        ("gnu lesser general public license", {"lgpl"}),
        ("permission is hereby granted free of charge to any persons obtaining copy", {"mit"}),
    ],
)
def test_license_near_misses(text, labels):
    assert {f[3] for f in license_scan.fuzzy(text, tuple(license_scan.NOTICES.items()), 10)} == labels


def test_license_base_against_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = by_id(license_scan.scan(spark.createDataFrame(d, "doc_id long, text string")))
    for r in d:
        w = license_scan.WORD.findall((r.text or "").translate(license_scan.LOWER))
        hits = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits})))


def test_license_keeps_fuzzy_places_before_an_exact_one():
    text = "undr the mit license undr the mit license under the mit license"
    found = [f for f in license_scan.fuzzy(text, tuple(license_scan.NOTICES.items()), 10) if f[3] == "mit"]
    assert [(b, e) for _, b, e, _ in found] == [(20, 1), (41, 1), (63, 0)]


def test_substring_dedup(unique, docs):
    first, size = {}, 13
    words = {r.doc_id: WORDS.findall(r.text or "") for r in unique.collect()}
    for i, w in sorted(words.items()):
        for j in range(len(w) - size + 1):
            first.setdefault(tuple(w[j : j + size]), i)
    got = by_id(substring_dedup.dedup_words(unique))
    for i, w in words.items():
        gone = {j + k for j in range(len(w) - size + 1) if first[tuple(w[j : j + size])] < i for k in range(size)}
        assert got[i].text == " ".join(x for j, x in enumerate(w) if j not in gone) and got[i].n_removed == len(gone)
    assert substring_dedup.dedup_words(docs).count() == docs.count()


def test_suffix_dedup(unique):
    seen, got = set(), by_id(suffix_dedup.dedup_bytes(unique))
    for r in sorted(unique.collect(), key=lambda r: r.doc_id):
        data, gone = (r.text or "").encode(), set()
        for j in range(len(data) - 99):
            if data[j : j + 100] in seen:
                gone.update(range(j, j + 100))
            seen.add(data[j : j + 100])
        x = got[r.doc_id]
        assert bytes(x.kept) == bytes(c for j, c in enumerate(data) if j not in gone)
        assert x.n_spans == sum(j - 1 not in gone for j in gone)


@pytest.mark.parametrize("kind,size,gram", [("bytes", 100, 16), ("words", 13, 5)])
def test_anchors_spread_over_buckets(kind, size, gram):
    """Anchors are the lowest of many hashes; each bucket gets its share of them all the same."""
    from tallyframe.llm import repeats

    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9999, 400)).encode() for _ in range(200)]
    runs, plan = repeats.Runs(texts, kind, size, gram), repeats.Plan(kind, size, gram, True, 16)
    distinct = np.unique(runs.anchor)
    each = np.bincount(plan.bucket(distinct), minlength=16)
    assert each.max() < 1.5 * len(distinct) / 16 and each.min() > len(distinct) / 16 / 1.5
    sent = [(k, repeats._unpack_hashes(payload)[0]) for k, _, payload in plan.split(0, [plan.anchors(runs)])]
    assert [k for k, _ in sent] == list(range(16)) and all((plan.bucket(h) == k).all() and (np.diff(h) > 0).all() for k, h in sent)
    assert np.array_equal(np.sort(np.concatenate([h for _, h in sent])), distinct)


def test_earliest_places_of_lone_and_met_contents():
    rng = np.random.default_rng(12)
    size, base = 10, bytes(rng.integers(97, 99, 60, dtype=np.uint8))
    made = [b"ABCDEFGHIJKL", b"c" * 13, b"de" * 9, b"xyzfghfghfghfgh", b"qrstuvwxyz", base, base[5:40], base[9:50], b"0123456789ABC0123456789A"]
    contents = [[h, c, 100 * i + 7] for i, (h, c) in enumerate(zip([1, 2, 3, 4, 5, 6, 6, 6, 7], made))]
    for some in (contents, contents[:1], contents[:5], contents[5:8], []):
        first: dict = {}
        for _, c, at in some:
            for j in range(len(c) - size + 1):
                first.setdefault(c[j : j + size], at + j)
        want = [[first[c[j : j + size]] for j in range(len(c) - size + 1)] for _, c, _ in some]
        assert [x.tolist() for x in suffix_dedup.earliest_places(some, size)] == want


def test_short_texts_that_repeat_themselves(spark):
    """Overlapping repeats within one run of windows, from the shortest on."""
    texts = ["a" * 100, "b" * 101, "c" * 150, "de" * 51, "fgh" * 60, "ijklmnopqrstuvwxyz0123456789" * 6, "".join(chr(0x100 + i) for i in range(40)) + "A" * 120]
    got = by_id(suffix_dedup.dedup_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        data, seen, gone = t.encode(), set(), set()
        for j in range(len(data) - 99):
            if data[j : j + 100] in seen:
                gone.update(range(j, j + 100))
            seen.add(data[j : j + 100])
        assert bytes(got[i].kept) == bytes(c for j, c in enumerate(data) if j not in gone), t


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(6)
    for data in (b"", b"a", b"banana", b"zzzzzzzzz", b"mississippi" * 9, bytes(rng.integers(0, 3, 700, dtype=np.uint8)), bytes(rng.integers(250, 256, 300, dtype=np.uint8))):
        t = np.frombuffer(data, np.uint8)
        order = suffix_dedup.suffix_array(t, 1000).tolist()
        assert order == sorted(range(len(t)), key=lambda i: data[i:])
        want = [0] * min(1, len(t)) + [len(os.path.commonprefix([data[a:], data[b:]])) for a, b in zip(order, order[1:])]
        assert suffix_dedup.common_prefixes(t, np.array(order, np.int64), 1000).tolist() == want


def test_automaton_finds_the_smallest_document():
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("ab"), int(n))) for n in rng.integers(0, 60, 30)]
    automaton, numbers = substring_dedup.Automaton(), rng.permutation(30).tolist()
    for t, n in zip(texts, numbers):
        automaton.add(t, n)
    automaton.close()
    for t in [*texts, "abab" * 20, "c" * 9 + texts[0]]:
        want = [min((n for x, n in zip(texts, numbers) if t[i : i + 6] in x), default=None) for i in range(len(t) - 5)]
        assert list(automaton.statistics(t, 6)) == want


def planted(spark, n=60, copies=40):
    """Documents with passages that many share, repeats within one, copies, ties and an id beyond doubles."""
    rng = np.random.default_rng(9)
    word = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 9999, k))
    shared = [word(40), word(30), "z" * 300]
    rows = [(i, " ".join([word(int(rng.integers(0, 50))), shared[i % 3], word(int(rng.integers(0, 30))), shared[0] if i % 7 == 0 else ""])) for i in range(n)]
    rows += [(100 + i, " ".join([shared[0], word(5)])) for i in range(copies)] + [(BIG, rows[3][1]), (-5, rows[8][1])]
    return [(i, t, "x") for i, t in rows]


@pytest.mark.parametrize("often", [512, 3])
def test_planted_passages(spark, monkeypatch, often):
    """Both with and without the second exchange, for very frequent anchors."""
    from tallyframe.llm import repeats

    rows = planted(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string, f string").repartition(5)
    monkeypatch.setattr(repeats, "OFTEN", often)
    monkeypatch.setattr(repeats, "BLOCK_ROWS", 7)
    first: dict = {}
    words = {i: t.split() for i, t, _ in rows}
    for i, w in sorted(words.items()):
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    got = by_id(substring_dedup.dedup_words(df))
    for i, w in words.items():
        gone = {j + k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for k in range(13)}
        assert got[i].text == " ".join(x for j, x in enumerate(w) if j not in gone) and got[i].n_removed == len(gone)
    seen, got = set(), by_id(suffix_dedup.dedup_bytes(df))
    for i, t, _ in sorted(rows):
        data, gone = t.encode(), set()
        for j in range(len(data) - 99):
            if data[j : j + 100] in seen:
                gone.update(range(j, j + 100))
            seen.add(data[j : j + 100])
        assert bytes(got[i].kept) == bytes(c for j, c in enumerate(data) if j not in gone)
        assert got[i].n_spans == sum(j - 1 not in gone for j in gone)


def brute_top_k(rows, k=20):
    v = {}
    for i, x in rows:
        v.setdefault(i, []).append([math.floor(64 * float(y)) for y in x])
    out = set()
    for q in v:
        if q % 20 == 0:
            own = min(v[q])
            every = sorted((-sum(a * b for a, b in zip(own, c)), i) for i, cs in v.items() if i != q for c in cs if len(c) == len(own))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(every[:k])}
    return out


def test_top_k(spark, monkeypatch):
    """Ties, repeated and negative ids, other lengths, odd vectors, large components; blocks of a few rows."""
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in rng.integers(-3, 3, 5)]) for i in range(-40, 90)] + [(200 + i, [1.0, 0.5, 0.25, 2.0, 1.0]) for i in range(60)]
    good += [(i, [float(x) for x in rng.normal(0, 1e6, 5)]) for i in range(300, 330)] + [(20, [9.0] * 5), (41, [1.0, 2.0]), (60, [1.0, 1.0]), (400, [0.5]), (401, [2.0])]
    odd = [(90, None), (91, [1.0, None, 1.0, 1.0]), (92, [float("nan")] * 4), (93, [float("inf")]), (None, [1.0]), (94, []), (500, [1e18])]
    df = spark.createDataFrame([(*r, "x") for r in good + odd], "vec_id long, embedding array<double>, score string")
    want = brute_top_k(good)
    assert set(map(tuple, topk.top_k(df).collect())) == want
    monkeypatch.setattr(topk, "BLOCK", 16)
    assert set(map(tuple, topk.top_k(df).collect())) == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", "One two", "one TWO"]
    for _ in range(6):
        w = list(rng.choice([f"w{i}" for i in range(500)], int(rng.integers(20, 200))))
        for _ in range(6):
            texts.append(" ".join(w))
            w = [*w[int(rng.integers(0, 5)) :], *(f"n{x}" for x in rng.integers(0, 99, int(rng.integers(0, 6))))]
    sets = {}
    for i, t in enumerate(texts):
        w = WORDS.findall((t or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def test_near_duplicates_joins_two_hubs(spark):
    """x and y are similar and have 120 edited copies each; no copy is similar to anything but its hub."""
    rng = np.random.default_rng(11)
    fresh = iter(range(10**6))

    def edited(w, n):
        w = list(w)
        for i in rng.choice(len(w) // 6, n, replace=False):
            w[6 * i] = f"e{next(fresh)}"
        return w

    x = [f"w{i}" for i in range(400)]
    y = edited(x, 9)
    texts = [" ".join(w) for w in [*(edited(x, 10) for _ in range(120)), x, y, *(edited(y, 10) for _ in range(120))]]
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got.where("component_id = 0").count() == len(texts)


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """Null ids, rows of one id, repeated rows, empty texts, an id beyond doubles, a clashing column."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[:90], f"x{i}"]) for i in range(20)]
    rows = [(None, t, 1) for t in texts] + [(7, "a b c d e f", 1), (7, "a b c d e f", 1), (7, "g h i j k l", 1), (None, None, 1), (None, "", 1), (8, " ", 1), (BIG, "a b c d e f", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    got = near_dedup.near_duplicates(df)
    assert got.count() == len(rows) and got.where("doc_id is null and n_shingles > 0 and kept").count() == 1
    assert got.where("n_shingles = 0 and kept").count() == 3
    assert {(r.doc_id, r.component_id, r.kept) for r in got.where(f"doc_id in (7, {BIG})").collect()} == {(7, 7, True), (BIG, 7, False)}
    left = near_dedup.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(left.groupBy("doc_id").count().na.fill(-1).collect()) == [(-1, 3), (7, 2), (8, 1)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_long_words_have_hashes_of_their_own(spark):
    """Sequences that a polynomial modulo 2^64 can't tell apart."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    df = spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string")
    assert near_dedup.near_duplicates(df).where("kept").count() == 2
    long = [(0, " ".join([a] * 13)), (1, " ".join([b] * 13))]
    assert substring_dedup.dedup_words(spark.createDataFrame(long, "doc_id long, text string")).where("n_removed > 0").count() == 0


def test_components_in_one_task_and_not(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 30) if i % 10 < 9] + [(5, 2), (-7, 5)], "a long, b long")
    want = {(i, -7) for i in range(10)} | {(i, i // 10 * 10) for i in range(10, 30) if i % 10}
    assert set(map(tuple, near_dedup.components(edges).where("s <> root").collect())) == want
    assert set(map(tuple, near_dedup.components(edges, 0).where("s <> root").collect())) == want


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    x = langid.identify(d, langid.train(d)).where("pmod(crc32(cast(doc_id as string)), 3) = 1")
    assert x.where("lang_pred = lang").count() >= 0.97 * x.count() and x.where("rejected").count() <= 0.02 * x.count()


UNLEARNED = {
    "it": "La casa è molto grande e i bambini giocano nel giardino mentre la madre prepara la cena per tutta la famiglia",
    "pt": "O menino foi à escola com os seus amigos e depois voltou para casa porque estava muito cansado e não queria brincar",
    "nl": "Gisteren ben ik naar de winkel gegaan en heb ik brood, melk en een paar appels gekocht omdat de hele familie kwam",
    "pl": "Wczoraj poszedłem do sklepu i kupiłem chleb, mleko oraz kilka jabłek, ponieważ przyjechała do nas cała rodzina",
    "fi": "Eilen kävin kaupassa ja ostin leipää, maitoa ja muutaman omenan, koska koko perhe tuli meille kylään",
    "ru": "Вчера я пошёл в магазин и купил хлеб, молоко и несколько яблок, потому что к нам приехала вся семья",
    "ja": "昨日は店に行ってパンと牛乳とりんごを買いました。家族みんなが遊びに来たからです。",
    "consonants": "xkcdvb wrtzpl qgfhdn mbvcxk trwqpl zsdfgh kjlmnb vcxzqw rtpsdf ghjklm nbvcxz qwrtps dfghjk lmnbvc",
}


def test_language_rejects_the_unlearned(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(d)
    x = spark.createDataFrame(list(UNLEARNED.items()), "name string, text string")
    assert langid.identify(x, model).where("not rejected").collect() == []
    held = langid.identify(d, model).where("pmod(crc32(cast(doc_id as string)), 3) = 1 and lang_pred = lang")
    assert held.where("rejected").count() <= 0.02 * held.count()


def test_language_of_a_text_does_not_depend_on_its_neighbours(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(d)
    texts = [(r.text or "").encode() for r in d.limit(40).collect()] + [b"", b"a", b"und", "ça".encode()]
    p, familiar = model.judged(texts)
    for i, t in enumerate(texts):
        one, f = model.judged([t])
        assert np.allclose(one[0], p[i]) and np.isclose(f[0], familiar[i])


def test_language_edges(docs):
    got = langid.identify(docs, langid.fit([], []))
    assert got.where("doc_id in (4, 5, 6)").where("lang_pred = 'und' and rejected").count() == 3
    assert got.count() == docs.count()


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Targets by resharing what is above the caps until none is."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(full.values())
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = {s: cap * sizes[s] for s in free if target[s] > cap * sizes[s]}
        if not above:
            return {**full, **target}
        full |= above


def test_targets_against_resharing(spark):
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 9):
        sizes = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 1000, n))} | {None: int(rng.integers(1, 300))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got.keys() == sizes.keys() and all(abs(got[s] - x) < 1e-6 for s, x in plain_targets(sizes).items())


def plain_pipeline(spark, rows):
    """run()'s rows by plain means: the same classifier, then brute force and the tiktoken library."""
    import tiktoken

    d = spark.createDataFrame(rows, COLS)
    model = langid.train(d)
    kept = [r for r in rows if r[1] is not None and langid.LETTER.search(r[1]) and model.judged([r[1].encode()])[1][0] >= model.reject]
    big = 1 << 63
    number = lambda r: big if r[0] is None else r[0]
    kept = list(dict.fromkeys(kept))
    sets = []
    for r in kept:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1]))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(kept)))
    for _ in kept:
        for a, b in combinations(range(len(kept)), 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(i)
    kept = [kept[min(g, key=lambda i: number(kept[i]))] for g in groups.values()]
    first: dict = {}
    for r in sorted(kept, key=number):
        w = WORDS.findall(r[1])
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), number(r))
    cut = []
    for r in kept:
        w = WORDS.findall(r[1])
        gone = {j + k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < number(r) for k in range(13)}
        text = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else r[1]
        if WORDS.search(text):
            cut.append((r[0], text, r[3]))
    sizes = Counter()
    for i, text, source in cut:
        sizes[source] += len(WORDS.findall(text))
    target, out = plain_targets(sizes), []
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks, special_tokens={})
    for source in sizes:
        left = math.floor(target[source])
        mine = sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i, text) for i, text, s in cut if s == source)
        while left > 0:
            for _, i, text in mine:
                w = WORDS.findall(text)
                if left > 0:
                    text = text if left >= len(w) else " ".join(w[:left])
                    ids = enc.encode_ordinary(text)
                    out.append((i, len(ids), tuple(ids), hashlib.sha256(text.encode()).hexdigest()))
                left -= len(w)
    return Counter(out)


def test_pipeline_against_plain_python(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(90).collect()
    rng = np.random.default_rng(12)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, None) for r in d]
    texts = sorted((r.text for r in d if r.text and len(r.text) > 600), key=len)[:12]
    for i, t in enumerate(texts):  # near copies, copies of passages, rejects, nulls, repeated rows
        w = t.split()
        rows.append((2000 + i, " ".join([*w[: len(w) - 3], f"new{i}"]), None, None, 0, None))
        rows.append((3000 + i, " ".join([*rng.permutation(w).tolist(), *w[5:40]]), "en", "new", 0, None))
    rows += [(4000, None, "en", "a", 0, None), (4001, "12 34", None, "a", 0, None), (4002, "", "en", None, 0, None), (4003, "xkcdvb wrtzpl qgfhdn mbvcxk trwqpl zsdfgh " * 5, None, "a", 0, None), rows[0], rows[0]]
    spark.createDataFrame(rows, COLS).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == plain_pipeline(spark, rows)


def test_pipeline_stages_on_odd_rows(spark, docs):
    """Null and repeated ids, null texts and sources, a clashing column, an empty table."""
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, "").columns == corpus_pipeline.COLUMNS, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    rows = [(None, f"w{i} a b", None, None, 0, None) for i in range(5)] + [(1, "c d e", None, "s", 0, None)] * 3
    taken = corpus_pipeline.mixture(spark, spark.createDataFrame(rows, COLS), "").collect()
    words = Counter()
    for r in taken:
        words[r.source] += len(r.text.split())
    assert words == {s: math.floor(x) for s, x in plain_targets({None: 15, "s": 9}).items()}


NAMES = "key range size kept found k s n path text_hash row words _r c q score rank stratum bits t f kind payload".split()
OPERATORS = {
    "token_files": lambda d, spark: token_output.token_files(d, P.path("word_bpe_49k.json")),
    "mix_sources": lambda d, spark: mixing.mix_sources(d),
    "quality": lambda d, spark: quality.quality(d, spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")),
    "scan": lambda d, spark: license_scan.scan(d),
    "dedup_words": lambda d, spark: substring_dedup.dedup_words(d),
    "dedup_bytes": lambda d, spark: suffix_dedup.dedup_bytes(d),
    "near_duplicates": lambda d, spark: near_dedup.near_duplicates(d),
    "identify": lambda d, spark: langid.identify(d, langid.train(d)),
    "encode": lambda d, spark: bpe.encode(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_operator_on_odd_rows(spark, name):
    """Nulls in any column, empty and long texts, ties, repeated rows, an id beyond doubles, clashing columns, an empty table: a row for each."""
    passage = " ".join(f"w{i} under the mit license" for i in range(40))
    texts = [None, "", " \n", "one", passage, passage, passage + " x", "y" * 5000, " ".join(f"v{i % 7000}" for i in range(30_000))]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", None][i % 2], 1, *NAMES) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, passage, None, None, None, *NAMES), (None, passage, None, None, None, *[None] * len(NAMES)), (BIG, passage, "en", "a", 1, *NAMES)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES))
    got = OPERATORS[name](df, spark).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    same = [tuple(r) for r in got if r.doc_id == 4]
    if name not in ("token_files", "mix_sources"):  # there rows that are equal have places of their own
        assert len(set(map(str, same))) == 1
    assert OPERATORS[name](df.limit(0), spark).count() == 0
