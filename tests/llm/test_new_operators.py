"""Ranked search, conversation repair and line removal against brute force, with the awkward cases."""

import hashlib
import itertools
import random
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from scriptorium.llm import conversations, lexical, line_dedup

CLASH = "n_lines long, n_dropped long, lines string, row string, k1 long, hi string, score double, rank int, batch int"
NONE = [None] * 9


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ranked search


def terms(text):
    out, word = [], ""
    for c in low(text or "") + " ":
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def ranked(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    df = Counter(w for _, c in counts for w in c)
    wanted = {}
    for item, t in items:
        wanted.setdefault(item, set()).update(terms(t))
    rows = []
    for item, ws in wanted.items():
        found = []
        for (i, c), size in zip(counts, sizes):
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * (50 + 50 * size * n // total))) for w in ws if w in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        rows += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Éa", "ßx", "the", "The", "中文", "x_y"]
    make = lambda n: r.choice([" ", "-", "\n"]).join(r.choice(words[: r.choice([5, 30, 66])]) for _ in range(n))
    docs = [(i * 3, make(r.choice([1, 4, 40, 300]))) for i in range(160)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(7, None), (8, ""), (9, "... !"), (None, make(9)), (None, docs[5][1]), (3, docs[1][1]), (10, "w1 " * 30_000)]
    r.shuffle(docs)
    items = [(i, make(r.choice([1, 3, 25]))) for i in range(12)] + [(50, None), (51, "!!"), (52, "unknownword"), (1, "w9 w10"), (None, "w3 The")]
    return docs, items


def test_search_against_brute_force(spark, corpus):
    docs, items = corpus
    df = spark.createDataFrame([(*d, *NONE) for d in docs], f"doc_id long, text string, {CLASH}").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for k in (3, 50):
        got = sorted(map(tuple, lexical.search(df, bench, k=k).collect()), key=str)
        assert got == ranked(docs, items, k)
    assert lexical.search(df.limit(0), bench).count() == lexical.search(df, bench.limit(0)).count() == 0


def test_search_in_shards_and_blocks(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, lexical.search(df, spark.createDataFrame(items, "item_id long, text string"), k=7).collect()), key=str) == ranked(docs, items, 7)


def test_shard_leaves_what_cannot_be_among_the_best(monkeypatch):
    """One document in 4,096 holds both rare terms: few of the others are scored."""
    n, seen = 4096, []
    doc = np.concatenate([np.arange(n), [77], [77]]).astype(np.int32)
    block = lexical.squeeze(np.arange(n), np.full(n, 4), np.array([0, 1, 2], np.int32), np.array([n, 1, 1], np.int32), doc, np.ones(n + 2, np.int32))
    shard = lexical.Shard(block, np.array([1, 500, 900]), n, 4 * n)
    best = lexical.Best(1)
    inner = lexical.Best.add
    monkeypatch.setattr(lexical.Best, "add", lambda self, s, i: (seen.append(len(s)), inner(self, s, i)))
    shard.search(np.array([0, 1, 2]), best)
    assert best.ids.tolist() == [77] and sum(seen) < 10
    # range maxima against plain ones, leftmost of equal
    r = np.random.default_rng(3)
    left, right = np.sort(r.integers(0, n, (2, 50)), axis=0)
    value, at = shard.bounds(left[:, None], right[:, None])
    assert [int(v) for v in value] == [int(shard.impact[a:b].max()) if b > a else 0 for a, b in zip(left, right)]
    assert [int(d) for d, a, b in zip(at, left, right) if b > a] == [int(shard.doc[a + shard.impact[a:b].argmax()]) for a, b in zip(left, right) if b > a]


# conversation repair


def plain_repair(rows):
    """rows: (role, text, fault). The least of all audits by a search over rows and states, with whole audits kept."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    best = {0: (0, "", ())}

    def put(into, state, cost, audit, out):
        if state not in into or (cost, audit) < into[state][:2]:
            into[state] = (cost, audit, out)

    def with_inserts(best):
        full = dict(best)
        for _ in range(3):
            for s, (c, a, o) in list(full.items()):
                r = "assistant" if s == 2 else "user"
                put(full, step[s, r[0]], c + 3, a + "I", (*o, f"{r}:"))
        return full

    for role, text, fault in rows:
        after = {}
        for s, (c, a, o) in with_inserts(best).items():
            put(after, s, c + 4, a + "D", o)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (s, role[:1]) in step:
                    put(after, step[s, role[:1]], c + more, a + "K", (*o, f"{role}:{text}"))
                r = "assistant" if s == 2 else "user"
                put(after, step[s, r[0]], c + 3 + more, a + "R", (*o, f"{r}:{text}"))
        best = after
    cost, audit, out = min(v for s, v in with_inserts(best).items() if s in (0, 3))
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_report(rows):
    """rows of one conversation: (turn, role, text)."""
    rows = sorted(((t is not None, t or 0, r, x) for t, r, x in rows))
    seen, out = set(), []
    for *_, r, x in rows:
        said = x.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (r, x) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((r, x))
        out.append((r, x, fault))
    turns = [t for some, t, *_ in rows if some]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults = [sum(f == k for *_, f in out) for k in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(out))
    return (gaps, *faults, illegal, *plain_repair(out))


@pytest.fixture(scope="module")
def talks():
    r = random.Random(12)
    texts = ["Yes.", "No", "Why?", "", " \t", "ß…", "Done! ", "a.\nb", "\x1c", " x.  "]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(r.choice([0, 1, 2, 5, 9, 30])):
            for _ in range(r.choice([1, 1, 1, 2, 3])):
                rows.append((conv, r.choice([turn, turn, turn * 2, None]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "sys"]), r.choice(texts)))
    rows += [(99, 5, "user", "same.")] * 50 + [(98, i, r.choice(["user", "assistant"]), f"{i}{r.choice('.!?,')}") for i in range(300)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_rows", [4096, 4, 1])
def test_repair_against_a_plain_search(spark, talks, block_rows):
    df = spark.createDataFrame([(*t, "x", 1) for t in talks], "conv_id long, turn long, role string, text string, block string, n long").repartition(3)
    want = {}
    for conv, *row in talks:
        want.setdefault(conv, []).append(row)
    want = {c: plain_report(rows) for c, rows in want.items()}
    got = {}
    for x in conversations.repaired(df, block_rows).collect():
        sha = hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in x.turns).encode()).hexdigest()
        got[x.conv_id] = (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, sha)
    assert got == want


def test_repaired_rows_have_the_form(spark, talks):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    for x in conversations.repaired(df).collect():
        roles = "".join(t.role[:1] for t in x.turns)
        assert roles.removeprefix("s") == "ua" * (len(roles) // 2) and (roles != "s")
        assert len(x.audit) - x.audit.count("D") == len(x.turns)


def test_damage(spark):
    import zlib

    rows = [(c, t, r, x) for c in (1, 2, None) for t in (*range(60), None) for r, x in [("assistant", "a.b! c?"), (None, None)]]
    got = Counter(map(tuple, conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = Counter()
    for c, t, r, x in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        want[c, t, "user" if how == 4 else r, "" if how == 1 else x.translate({ord(k): None for k in ".!?"}) if how == 2 else x, {0: 0, 3: 2}.get(how, 1)] += 1
    assert got == want
    dropped = spark.createDataFrame([(5, 1, "user", "x", 0)], "conv_id long, turn long, role string, text string, times int")
    only = conversations.repaired(dropped).first()
    assert (only.conv_id, only.gaps, only.cost, only.audit, only.turns) == (5, 0, 0, "", [])
    assert conversations.repaired(dropped.limit(0)).count() == 0


def test_crossings_are_the_least(spark):
    r = random.Random(2)
    for _ in range(300):
        rows = [(r.choice("sua."), r.random() < 0.3, r.random() < 0.2) for _ in range(r.randint(0, 9))]
        units = [conversations.row_unit("-" if gone else k, cut and not gone) for k, cut, gone in rows]
        kinds = "".join("-" if gone else (k.upper() if k != "." else "!") if cut else k for k, cut, gone in rows)
        names = {"s": "system", "u": "user", "a": "assistant", ".": "tool"}
        plain = [(names[k], "t", "blank" if gone else "truncated" if cut else "") for k, cut, gone in rows]
        cost, audit, _ = conversations.solved(kinds, [1] * len(rows), [p[0] for p in plain], [p[1] for p in plain], 0, None, True)
        assert (cost, audit) == plain_repair(plain)[:2] and len(units) == len(rows)


# lines


def plain_lines(docs, min_docs, min_chars=1):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    split = [(i, (t or "").split("\n")) for i, t in docs]
    df = Counter(k for _, ls in split for k in {key(x) for x in ls})
    gone = {k for k, n in df.items() if n >= min_docs and len(k) >= min_chars}
    return sorted(((i, len(ls), sum(key(x) in gone for x in ls), "\n".join(x for x in ls if key(x) not in gone)) for i, ls in split), key=str)


@pytest.fixture(scope="module")
def lined():
    r = random.Random(13)
    lines = ["", " ", "Cookies", "cookies ", "COOKIES\t", "É", "é", "a\r", "A", "中", "\x0b", "rare", "x" * 5000]
    docs = [(i, "\n".join([r.choice(lines), *(f"own {i} {k}" for k in range(r.choice([0, 1, 5]))), r.choice(lines)])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, "cookies\nx"), (None, "cookies\nx"), (None, "a"), (5, "a\na\na"), (103, "cookies\n" * 30_000)]
    return docs


@pytest.mark.parametrize("batches", [1, 7])
def test_lines_against_brute_force(spark, lined, batches):
    df = spark.createDataFrame([(*d, *NONE) for d in lined], f"doc_id long, text string, {CLASH}").repartition(3)
    for min_docs, min_chars in ((2, 1), (6, 2)):
        got = line_dedup.report(df, min_docs, min_chars, batches)
        assert sorted(((x.doc_id, x.n_lines, x.n_dropped, x.text or "") for x in got.collect()), key=str) == plain_lines(lined, min_docs, min_chars)
    kept = line_dedup.clean(df, 2)
    assert kept.columns == df.columns and kept.count() == len(lined)
    assert line_dedup.report(df.limit(0)).count() == 0


def test_runs_are_levelled_and_opened_again(spark):
    runs = line_dedup.LineRuns(spark, min_docs=4)
    shapes = []
    for b in range(9):
        runs.add(spark.createDataFrame([(k, k) for k in range(b, b + 3)] + [(-1, 0)] * 2, "hi long, lo long"))
        shapes.append([len(x) for x in runs.levels])
    assert shapes[1:4] == [[2], [0, 1], [1, 1]] and shapes[-1] == [0, 0, 1]
    again = line_dedup.LineRuns.open(spark, runs.folder)
    again.add(spark.createDataFrame([(9, 9)] * 2, "hi long, lo long"))
    assert {(r.hi, r.lo): r.n for r in again.common().collect()} == {(-1, 0): 4, (9, 9): 4}  # settled after two batches
    assert again.buckets == runs.buckets and [len(x) for x in again.levels] == [1, 0, 1]


def test_batches_meet_runs_where_they_lie(spark):
    """A batch is shuffled once; runs are read by bucket and merged, not shuffled."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        runs = line_dedup.LineRuns(spark)
        runs.add(spark.range(1000).selectExpr("id AS hi", "id AS lo"))
        batch = spark.range(500, 2000).selectExpr("id AS hi", "id AS lo").groupBy("hi", "lo").count()
        plan = batch.join(spark.table(runs.levels[0][0]).hint("merge"), line_dedup.KEY, "left")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
