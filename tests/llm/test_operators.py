"""The training-data operators against brute force, on small fixtures with the awkward cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from scriptorium.llm import bwt, decontaminate, langid, ngram_join, packing, pii, quality, rlz, syncmers, warc
from scriptorium.llm.shared import components

DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket string"
BLANK = r"[^\x20\x09-\x0D]+"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = ["the", "and", "Of", "ing", "ent", "éa", "ßu", "to", "ation", "ré", "on", "x1"]
    make = lambda n: " ".join(r.choice(words) + r.choice(words) for _ in range(n))
    passage, line = make(60), make(25)
    base = [make(r.choice([5, 30, 90, 200])) for _ in range(12)]
    out = [None, "", " \n\t ", "a", "one two three", "go " * 300, "ab" * 400, make(4000)]
    out += base + base[:4] + base[:1] * 8
    for b in base:
        w = b.split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
        out.append(b[: len(b) // 2] + " " + passage + "\n" + line)
    out += [line + "\n" + make(40) for _ in range(10)] + [passage * 3]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "x") for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def test_rlz(docs, texts, empty):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = re.findall(BLANK, t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in rlz.dedup(docs).collect()} == want
    assert rlz.dedup(empty).count() == 0
    cover = {}
    for f in rlz.factors(docs).collect():
        cover.setdefault(f.doc_id, set()).update(range(f.start, f.start + f.length))
        own, source = re.findall(BLANK, texts[f.doc_id]), re.findall(BLANK, texts[f.source_doc_id])
        assert f.length >= 20 and own[f.start : f.start + f.length] == source[f.source_start : f.source_start + f.length]
        assert (f.source_doc_id, f.source_start) < (f.doc_id, f.start)
    assert {i: len(x) for i, x in cover.items()} == {i: w[1] for i, w in want.items() if w[1]}


def test_bwt(docs, texts, empty):
    first, want = {}, {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = [True] * 50
        want[i] = (len(b), sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)), bytes(x for x, g in zip(b, gone) if not g))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in bwt.dedup(docs).collect()} == want
    assert bwt.dedup(empty).count() == 0


def test_rows_that_share_an_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (1, long), (1, long), (2, "b " + long), (2, "a"), (3, "c " + long + " d"), (3, "c " + long + " d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed) for r in rlz.dedup(df).collect())
    assert got == [(-1, 60, 0), (1, 60, 60), (1, 60, 60), (2, 1, 0), (2, 61, 60), (3, 62, 60), (3, 62, 60)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed) for r in bwt.dedup(df).collect())
    n = len(long)
    # wholly in an earlier document, or in one that begins or ends alike
    assert got == [(-1, n, 0), (1, n, n), (1, n, n), (2, 1, 0), (2, n + 2, n), (3, n + 4, n + 1), (3, n + 4, n + 1)]
    # one id for a third of all rows, each with a text of its own: every text is kept and judged
    many = [(None, f"{long} {i}") for i in range(300)] + [(7, f"{i} {long}") for i in range(3)]
    out = rlz.dedup(spark.createDataFrame(many, "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in out) == [0] * 300 + [60] * 3 and len({r.text for r in out if r.doc_id is None}) == 300
    text_ids = spark.createDataFrame([("1", long), ("x", long), (None, "a")], "doc_id string, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in rlz.dedup(text_ids).collect()) == [(-1, 0), (-1, 0), (1, 60)]


def test_factors_are_greedy_and_long(spark):
    """A factor goes on past a window as long as its source does; where another source goes on, a new factor straddles."""
    r = random.Random(12)
    a, b = ([f"{x}{r.randrange(10**9)}" for _ in range(100)] for x in "ab")
    both = a[:50] + b[30:80]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(both)), (4, " ".join(both[35:65]))], "doc_id long, text string")
    got = sorted((f.doc_id, f.start, f.length, f.source_doc_id, f.source_start) for f in rlz.factors(df).collect())
    assert got == [(3, 0, 50, 1, 0), (3, 50, 50, 2, 30), (4, 0, 30, 3, 35)]
    words = np.array([3, 1, 2, 3, 4, 9, 1, 2, 3, 4, 5, 1, 2, 3, 4, 9], np.uint64)
    stretch, start, length, doc, source = rlz.factor(words, np.array([6, 5, 5]), np.array([1, 2, 3]), np.array([0, 10, 20]), 3)
    assert [x.tolist() for x in (stretch, start, length, doc, source)] == [[1, 2], [10, 20], [4, 5], [1, 1], [1, 1]]


def test_groups_follow_the_bytes(spark, monkeypatch):
    from scriptorium.llm import repeats

    df = spark.createDataFrame([(i, "x" * 1000) for i in range(400)], "doc_id long, text string")
    monkeypatch.setattr(repeats, "GROUP_BYTES", 10_000)
    assert repeats.bucket_count(df) == 40 and repeats.bucket_count(df.union(df)) == 80
    assert repeats.bucket_count(df.limit(0)) == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_merged_intervals():
    """Classes of windows come from the shards' merge: against a dictionary of windows."""
    r = random.Random(3)
    for length in (10, 7):
        strings = [bytes(r.choice(b"ab") for _ in range(r.randint(length, 40))) for _ in range(60)]
        sizes, owner = np.array([len(x) for x in strings]), np.array([r.randrange(20) for _ in strings])
        flat = np.frombuffer(b"".join(strings), np.uint8)
        got = bwt._least_in_classes(flat, sizes, owner, np.arange(60) * bwt.SHARDS // 60, length)
        least = {}
        for x, o in zip(strings, owner.tolist()):
            for k in range(len(x) - length + 1):
                least[x[k : k + length]] = min(least.get(x[k : k + length], 99), o)
        want = [least.get(x[k : k + length], o) for x, o in zip(strings, owner.tolist()) for k in range(len(x))]
        assert got.tolist() == want


@pytest.mark.parametrize(("n", "t"), [(4, 85), (5, 80), (1, 50)])
def test_ngram_join(docs, texts, empty, n, t):
    sets = []
    for x in texts:
        w = re.findall(BLANK, low(x or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= t * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, n, t).collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    assert ngram_join.join(empty, n, t).count() == 0


def test_ngram_join_answers_repeated_rows(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{near} x{i}" if i < 3 else " ".join(f"u{i}v{k}" for k in range(30))) for i in range(40)]
    across = spark.createDataFrame(rows, "doc_id long, text string")
    across = across.union(across)  # chunks with the same rows
    adjacent = spark.createDataFrame([r for r in rows for _ in range(2)], "doc_id long, text string").repartitionByRange(8, "doc_id")  # chunks that hold their rows twice
    want = sorted((i, len(t.split()) - 4, 0 if i < 3 else i) for i, t in rows for _ in range(2))
    for df in (across, adjacent):
        assert df.rdd.getNumPartitions() == 8 and sorted(tuple(r) for r in ngram_join.join(df).collect()) == want


def test_ngram_join_of_hot_grams(spark, monkeypatch):
    """A third of all rows are copies, many share a passage that does not suffice, some only just do: against brute force."""
    monkeypatch.setattr(ngram_join, "PAIR_ROWS", 7)
    r = random.Random(21)
    passage = [f"p{i}" for i in range(60)]
    words = lambda n: [f"w{r.randrange(400)}" for _ in range(n)]
    texts = [" ".join(passage)] * 120
    texts += [" ".join(passage[: r.randint(50, 60)] + words(r.randint(0, 14))) for _ in range(180)]
    texts += [" ".join(words(3) + passage + words(r.randint(0, 9))) for _ in range(60)] + [" ".join(words(40)) for _ in range(40)]
    r.shuffle(texts)
    sets = []
    for x in texts:
        w = x.split()
        sets.append(frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)))
    label = list(range(len(sets)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert {x.doc_id: x.component_id for x in ngram_join.join(df, 4, 85).collect()} == {i: find(i) for i in range(len(sets))}
    codes = ngram_join.frequency_codes(np.array([1, 2, 127, 128, 255, 1000, 10**6, 10**10]))
    assert codes[:3].tolist() == [1, 2, 127] and (np.diff(codes.astype(int)) > 0).all()
    ids = spark.createDataFrame([("x", "a b c d"), (None, "a b c d"), ("3", "a b c d")], "doc_id string, text string")
    assert [x.component_id for x in ngram_join.join(ids, 4, 85).collect()] == [3, 3, 3]


def test_components_of_long_paths(spark):
    n, r = 2000, random.Random(6)
    zigzag = [k // 2 if k % 2 == 0 else n - 1 - k // 2 for k in range(n)]
    edges = []
    for p, ids in enumerate((list(range(n)), list(range(n))[::-1], zigzag, r.sample(range(n), n))):
        edges += [(p * n + a, p * n + b) for a, b in zip(ids, ids[1:])]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.id: x.component for x in got} == {i: i // n * n for i in range(4 * n)} and len(got) == 4 * n
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_decide_per_row(spark):
    import corpus_pipeline

    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(3, a), (5, a + " x"), (5, b), (5, b), (5, b + "  y"), (None, c), (None, d), (None, d), (None, a), (7, e), (7, c), (8, ""), (8, ""), (None, None), (None, " "), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x") for i, t in rows], DDL)
    out = corpus_pipeline.near_duplicates(spark, df, "")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in out.collect())
    assert out.columns == df.columns
    either = [x for x in got if x in ((5, b), (5, b + "  y"))]
    assert len(either) == 1 and got == sorted([(3, a), *either, (-1, d), (7, e), (7, c), (8, ""), (8, ""), (-1, ""), (-1, ""), (-1, " ")])


def test_pii_spans():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def want(t):
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        out = [("email", *m.span()) for m in email.finditer(t)]
        out += [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        return out + [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(digits(m)) <= 15]

    r = random.Random(2)
    for _ in range(5000):
        t = "".join(r.choice(r.choice(["0123456789.", "@a.b-", "+12 ().-", "1.2.3", "4111 1111 1111 1111 ", "0123456789 -"])) for _ in range(r.randint(1, 60)))
        assert [s for s in pii.find_spans(t) if s[0] in pii.BASE_KINDS] == want(t), t
    assert pii.find_spans(None) == [] and pii.mask(None) is None
    assert pii.mask("mail joe@x.org, token = 'ab12cd34ef'!") == "mail [email], token = '[account]'!"


def test_pii_long_secrets_and_mixed_case():
    late = "x" * 300 + "7" + "y-_" * 200
    for cue in ("token", "Api_Key", "API-Key", "ApiKey", "pAsSwOrD"):
        assert pii.mask(f"é {cue}: {late}, end") == f"é {cue}: [account], end"
    assert pii.mask(f"see HTTPS://joe:{'p!' * 200}@x.org/a") == "see HTTPS://[login]/a"
    assert pii.find_spans("secret=password: ab12cd34") == [("account", 17, 25)]
    assert pii.find_spans("token=" * 300_000) == []  # in linear time
    assert pii.find_spans("token=" * 3 + "a1") == [("account", 6, 20)]


def test_pii_tables(docs, texts, empty):
    assert pii.find(docs).count() == len(texts) and pii.find(empty).count() == 0
    assert pii.redact(docs).columns == docs.columns


def test_decontaminate(spark, docs, texts, empty):
    items = [(1, texts[9]), (2, texts[9]), (3, "one two"), (4, None), (5, "--"), (6, " ".join(texts[7].split()[50:75]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = {}
    for i, t in enumerate(texts):
        w, hit, ids = words(t), set(), set()
        for x, items_ in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    ids |= items_
        want[i] = (len(w), len(hit), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
    key = lambda df: {r.doc_id: (r.n_words, r.n_hit, r.items_sha256) for r in df.collect()}
    assert key(decontaminate.report(docs, bench)) == want
    # several blocks give the same
    rows = {r.row: sum(e - s for s, e in decontaminate.merged(r.h_start, r.h_end)) for r in decontaminate.hits(docs.selectExpr("doc_id AS row", "text"), bench, block_windows=7).collect()}
    assert rows == {i: w[1] for i, w in want.items()}
    for r in decontaminate.cut(docs, bench).collect():
        assert (len(words(r.text)) <= want[r.doc_id][0] - want[r.doc_id][1]) if want[r.doc_id][1] else r.text == texts[r.doc_id]
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate._cut("Say, The quick BROWN fox!", [1], [4]) == "Say,  fox!"


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    got = packing.pack(docs).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 4096 and len(filled) <= -(-sum(filled.values()) // 4096) + 1
    assert packing.pack(empty).count() == 0


def test_packing_encoder():
    enc, r = packing.ChunkEncoder(packing.tokenizer_path()), random.Random(3)
    pool = [*"abCDéÉßñ .,!#'$12\n\tİſŸ中Σς-<|>", "<|endoftext|>", "'s", " the", "́", " "]
    for _ in range(3000):
        t = "".join(r.choice(pool) for _ in range(r.randint(0, 25)))
        assert next(iter(enc.encode([t]))) == enc.plain(t), repr(t)


def test_best_fit():
    lengths = np.array([7, 6, 5, 4, 3, 2, 1])
    bins, offsets = packing.best_fit_decreasing(lengths, 10)
    assert len(set(bins)) == 3 and offsets[0] == 0


def test_warc(spark):
    html = [None, "", "<p>é</p>", "<p>é</p>", "x\r\n\r\nWARC/1.1\r\n" * 30, "y" * 5000, "y" * 5000, "0\r\n\r\n"]
    pages = spark.createDataFrame([(i, f"http://h/{i} a", h, "extra") for i, h in enumerate(html)], "page_id long, url string, html string, digest string")
    got = {int(r.page_id): r for r in warc.round_trip(pages, segment_bytes=700).collect()}
    first = {}
    for i, h in enumerate(html):
        b = (h or "").encode()
        f = first.setdefault(b, i)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.intact) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), True)
        assert (r.record_type, r.refers_to) == (("response", None) if f == i else ("revisit", str(f)))
    assert got[5].segments > 5
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_missing_segment(spark):
    pages = spark.createDataFrame([(1, "u", "z" * 3000)], "page_id long, url string, html string")
    path = warc.fresh_path(spark, "t")
    warc.write(pages, path, 500)
    whole = warc.records(spark, path)
    assert warc.reassemble(whole).first()["size"] == 3000
    assert warc.reassemble(whole.where("segment <> 3")).first()["size"] is None


def test_syncmers(docs, texts, empty):
    got = {r.doc_id: r for r in syncmers.compare_edits(docs).collect()}
    n = len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i - 1) % n] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and got[i].fingerprint == got[texts.index(texts[i])].fingerprint
        assert (got[i].fingerprint == got[i].edited_fingerprint) <= (got[i].near_edited == 1)
    assert syncmers.compare_edits(empty).count() == 0


def test_syncmers_skip_nulls(spark):
    df = spark.createDataFrame([(None, "abcd"), (1, "xyzw"), (1, "xyzw")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.near_next is None) for r in syncmers.compare_edits(df).collect()) == [(-1, True), (1, False), (1, False)]


def test_language(spark, docs, empty):
    model = langid.fit(spark.createDataFrame([(i, "the and of ing ation " * 20, "en") for i in range(20)] + [(i, "éa ré eux ment ion le la " * 20, "fr") for i in range(20, 40)], "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, "the ation and the ing of"), (2, "ré eux le ment éa la"), (3, None), (4, "12 34 !"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()}
    assert got == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "und"}
    assert langid.predict(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(empty, model).count() == 0


def test_quality(spark, docs, texts, empty):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["plain", "words", "here", "and", "there"]) for _ in range(80)) if i % 2 else "### !!! $$$ " * 60, i % 2) for i in range(120)]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    got = {x.doc_id: x.predicted for x in quality.score(spark.createDataFrame(rows, "doc_id long, text string, quality int"), model).collect()}
    assert sum(got[i] == q for i, _, q in rows) >= 118
    assert quality.score(docs, model).count() == len(texts) and quality.score(empty, model).count() == 0
    assert quality.keep_good(docs, quality.Model()).columns == docs.columns
    assert quality.score(docs, quality.Model()).where("score <> 0.5").count() == 0


def test_attention_gradients():
    m, r = quality.Model(), np.random.default_rng(0)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, starts, y = r.random((7, quality.WIDTH)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    loss = lambda: float(-(y * np.log(s := m.forward(x, starts)["score"]) + (1 - y) * np.log(1 - s)).mean())
    grads = m.gradients(x, starts, y, np.ones(3))
    for k in m.p:
        i = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        keep, e = m.p[k][i], 1e-5
        m.p[k][i] = keep + e
        up = loss()
        m.p[k][i] = keep - e
        down = loss()
        m.p[k][i] = keep
        assert abs((up - down) / (2 * e) - grads[k][i]) < 1e-4 * max(1, abs(grads[k][i]))


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near duplicates", "benchmark", "personal data", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert corpus_pipeline.run(spark, sf).where("offset + length > 4096").count() == 0
