"""Duplicate operators against brute force over the awkward corpus and planted cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meshlark.llm import embedding_dedup, repeats, simhash, substring_dedup, suffix_dedup
from meshlark.llm.anchors import Windows, names
from tests.llm.fixture import documents, empty, rows, values, words


def plain_bytes(docs, span):
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = {}
    for _, b in texts:
        for k in range(len(b) - span + 1):
            seen[b[k : k + span]] = seen.get(b[k : k + span], 0) + 1
    out = []
    for i, b in texts:
        cut = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                cut[k : k + span] = True
        kept = bytes(x for x, c in zip(b, cut) if not c)
        out.append((i, len(b), int(cut.sum()), int((cut[1:] < cut[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def plain_words(docs, span):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    low = {}
    for i, w in texts:
        for k in range(len(w) - span + 1):
            key = tuple(w[k : k + span])
            if i is not None:
                low[key] = min(i, low.get(key, i))
    out = []
    for i, w in texts:
        cut = np.zeros(len(w), bool)
        for k in range(len(w) - span + 1):
            if i is not None and low[tuple(w[k : k + span])] < i:
                cut[k : k + span] = True
        kept = " ".join(x for x, c in zip(w, cut) if not c)
        out.append((i, len(w), int(cut.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(repr, out))


BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
WORDS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def planted(seed):
    """Texts that share random passages at random places, with edits, repeats and copies."""
    rng = random.Random(seed)
    pool = [words(rng, rng.randrange(20, 160)) for _ in range(6)]
    out = []
    for i in range(40):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += words(rng, rng.randrange(0, 40))
            p = list(rng.choice(pool))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            w += p[rng.randrange(0, 10) :]
        out.append((rng.randrange(0, 30), rng.choice([" ", "\n", "  "]).join(w)))
    return out


@pytest.mark.parametrize("span", [400, 100])
def test_repeats(spark, span):
    docs = [(i, t) for i, t, *_ in rows()]
    got = suffix_dedup.remove_repeats(documents(spark, clash=True), span=span, keep=("lang", "th"))
    assert values(got, *BYTES) == plain_bytes(docs, span)
    assert got.where("th <> 'clash'").count() == 0


def plain_word_cut(docs, span):
    """Texts without the 50-word passages of documents of smaller id, blanks after a removed run included."""
    alone = r"[\u0e00-\u0eff\u1000-\u10bf\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]"
    token = re.compile(f"{alone}|(?:(?!{alone})[^\\x20\\x09-\\x0D])+")
    found = [(i, t or "", [(m.start(), m[0]) for m in token.finditer(t or "")]) for i, t in docs]
    low = {}
    for i, _, w in found:
        for k in range(len(w) - span + 1):
            if i is not None:
                key = tuple(x for _, x in w[k : k + span])
                low[key] = min(i, low.get(key, i))
    out = []
    for i, t, w in found:
        gone = set()
        for k in range(len(w) - span + 1):
            if i is not None and low[tuple(x for _, x in w[k : k + span])] < i:
                gone |= set(range(k, k + span))
        ends = [s for s, _ in w[1:]] + [len(t)]
        out.append((i, (t[: w[0][0]] if w else t) + "".join(t[s:e] for k, ((s, _), e) in enumerate(zip(w, ends)) if k not in gone)))
    return sorted(map(repr, out))


def test_word_repeats_leave_the_first(spark):
    """Passages of 51 to 60 words go from all documents but the first, whatever the script; blanks stay."""
    rng = random.Random(11)
    docs = [(i, t) for i, t, *_ in rows()] + planted(12)
    for n in range(51, 61):
        passage = words(rng, n)
        docs += [(100 + n, " ".join([*words(rng, 20), *passage])), (200 + n, "\t ".join([*passage, *words(rng, 15)])), (300 + n, "\n".join([*words(rng, 5), *passage, "end"]))]
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(80))
    docs += [(400, "前" + han + "後 tail"), (401, "x" + han[5:70] + " y"), (402, "ไทย" * 30), (403, "a " + "ไทย" * 30)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), span=50, unit="word", leave_first=True)
    assert values(got, "doc_id", "text") == plain_word_cut(docs, 50)
    both = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), passage=50)
    assert values(both, *BYTES) == plain_bytes(docs, 400)
    alone = {(r.doc_id, r.n_bytes): r.n_removed > 0 for r in got.collect()}
    assert all((r.n_passage_words > 0) == alone[r.doc_id, r.n_bytes] for r in both.collect())
    left = {r.doc_id: r for r in got.where("doc_id between 101 and 403").collect()}
    assert all(left[100 + n].n_removed == 0 < left[200 + n].n_removed and left[300 + n].n_spans == 1 for n in range(51, 61))
    assert left[400].n_removed == 0 < left[401].n_removed and left[403].text == "a "


def test_planted_repeats(spark):
    docs = planted(4)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert values(got, *BYTES) == plain_bytes(docs, 400)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_passages(spark):
    docs = [(i, t) for i, t, *_ in rows()]
    assert values(substring_dedup.remove_passages(documents(spark, clash=True)), *WORDS) == plain_words(docs, 50)


@pytest.mark.parametrize("limit", [substring_dedup.LIMIT, 2])
def test_planted_passages(spark, limit):
    docs = planted(9)
    got = substring_dedup.remove_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), limit=limit)
    assert values(got, *WORDS) == plain_words(docs, 50)
    assert substring_dedup.remove_passages(empty(spark)).count() == 0


def test_equal_rows_do_not_multiply(spark, monkeypatch):
    rng, r, seen = random.Random(3), 5, []
    a = words(rng, 600)
    parts = [[*words(rng, 30), *a[k : k + 150], *words(rng, 30), *a[k + 170 : k + 300], "edit"] for k in (0, 90, 250)]
    docs = [(7, " ".join(a))] * r + [(5 + 2 * k, " ".join(w)) for k, w in enumerate(parts)]

    def spy(work, *rest, make=repeats.block_rows):
        seen.append(work.groupBy("doc_id", "th", "lo", "todo").count().selectExpr("max(count)", "max(size(todo) - size(array_distinct(todo)))").first())
        return make(work, *rest)

    monkeypatch.setattr(repeats, "block_rows", spy)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert values(suffix_dedup.remove_repeats(df), *BYTES) == plain_bytes(docs, 400)
    assert values(substring_dedup.remove_passages(df), *WORDS) == plain_words(docs, 50)
    assert len(seen) > 1 and all(n is not None and n <= r and twice == 0 for n, twice in seen)


def test_parse_factors():
    """Greedy factors, the windows across their ends, and no source of the same owner."""
    w = [xxhash.xxh3_64_digest(str(k).encode()) for k in range(200)]
    body = lambda *parts: b"".join(x for p in parts for x in p)
    a, b = body(w[:30]), body(w[20:50])
    block = [("a", 1, a), ("b", 2, b), ("c", 2, body(w[90:100], w[20:40])), ("d", 5, body(w[60:63], w[5:45], w[70:80])), ("e", 5, body(w[95:100], w[20:30], w[100:104]))]
    got = list(substring_dedup.parse(iter(block), 10))
    for k, (name, owner, text) in enumerate(block):
        words_of = [text[i : i + 8] for i in range(0, len(text), 8)]
        want = set()
        for i in range(len(words_of) - 9):
            if any(o < owner and b"".join(words_of[i : i + 10]) in {t[j : j + 80] for j in range(0, len(t) - 79, 8)} for _, o, t in block[:k]):
                want |= set(range(i, i + 10))
        factors = [f for f in got if f[0] == name]
        assert {i for _, _, at, n in factors for i in range(at, at + n)} == want
        assert all(n >= 10 and source < owner for _, source, _, n in factors)
        for (_, _, at, n), (_, _, then, _) in zip(factors, factors[1:]):
            assert then > at + n - 10  # the next factor starts at a window that crosses the end, or later
    assert max(n for name, _, _, n in got if name == "d") > 10


def test_factors_name_their_source(spark):
    w = words(random.Random(2), 400)
    docs = [(1, " ".join(w[:120])), (2, " ".join(w[60:200])), (3, "x y " + " ".join(w[30:180]))]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("th", F.xxhash64("text"))
    got = substring_dedup.factor_ranges(rows, 50).collect()
    assert {(r.doc_id, r.source) for r in got} == {(2, 1), (3, 1), (3, 2)}
    text = dict(docs)
    for r in got:
        assert " ".join(text[r.doc_id].split()[r.lo : r.lo + r.n + 49]) in text[r.source]


def test_anchors_own_every_window_once():
    rng = np.random.default_rng(0)
    raw, off = rng.integers(97, 99, 5000).astype(np.uint8), np.array([0, 10, 10, 1200, 1650, 5000])
    win = Windows(400, 32, 256)
    got = win.anchors(raw, off)
    seen = sorted((d, lo + k) for d, lo, n in zip(got["doc"].tolist(), got["lo"].tolist(), got["n"].tolist()) for k in range(n))
    assert seen == [(d, p) for d in range(5) for p in range(off[d + 1] - off[d] - 399)]
    a, b = names(raw, 4, 32)
    by = {}
    for k in range(len(a)):
        assert by.setdefault(raw[k : k + 4].tobytes(), a[k]) == a[k]
    assert len(set(b.tolist())) == len({raw[k : k + 32].tobytes() for k in range(len(b))})


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    """Smallest id of each node's component; a null id names none unless there is no other."""
    label = list(range(len(nodes)))
    for a in range(len(nodes)):
        for b in range(a):
            if linked(a, b) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    low = {}
    for i, x in zip(nodes, label):
        low.setdefault(x, []).append(i)
    return [min((i for i in low[x] if i is not None), default=None) for x in label]


@pytest.mark.parametrize("block", [simhash.BLOCK, 12])
def test_simhash(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    docs = [(i, t) for i, t, *_ in rows()]
    rng = random.Random(5)
    base = words(rng, 400)
    for k in range(120):  # near copies in chains
        base[rng.randrange(400)] = f"w{k}"
        docs.append((1000 + k, " ".join(base)))
    fp = [plain_fingerprint(t) for _, t in docs]
    comp = plain_components([i for i, _ in docs], lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit(1)).repartition(5))
    want = [(i, format(f, "016x"), c) for (i, _), f, c in zip(docs, fp, comp)]
    got = got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert values(got) == sorted(map(repr, want))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_long_runs_agree_with_short_ones(spark, monkeypatch):
    rng = np.random.default_rng(2)
    core = rng.integers(0, 2**63, 3).astype(np.uint64)
    fp = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) for c in core]))
    label = plain_components(list(range(len(fp))), lambda a, b: int(fp[a] ^ fp[b]).bit_count() <= 3)
    i, a = simhash.anchors((fp >> np.uint64(32)))
    j, b = simhash.anchors((fp & np.uint64(0xFFFFFFFF)))
    import pyarrow as pa

    key, at = np.concatenate((a.astype(np.int64) << 1, (b.astype(np.int64) << 1) | 1)), np.concatenate((i, j))
    order = np.argsort(key, kind="stable")
    batch = pa.RecordBatch.from_arrays([pa.array(key[order]), pa.array(fp[at[order]].view(np.int64))], ["anchor", "fp"])
    for most in (96, 2):
        monkeypatch.setattr(simhash, "LONG_RUN", most)
        place = {int(f): k for k, f in enumerate(fp)}
        links = [(place[int(np.uint64(np.int64(u)))], place[int(np.uint64(np.int64(v)))]) for out in simhash._links(3)([batch.slice(0, 700), batch.slice(700)]) for u, v in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
        got = list(range(len(fp)))
        for u, v in links:
            if got[u] != got[v]:
                old, new = max(got[u], got[v]), min(got[u], got[v])
                got = [new if x == old else x for x in got]
        assert got == label


def test_one_of_equal_texts_is_the_same_everywhere(spark):
    text = " ".join(words(random.Random(3), 40))
    df = spark.createDataFrame([(1, text, s) for s in ("c", "a", "b")], "doc_id long, text string, source string")
    for n in (1, 3):
        assert [r.source for r in simhash.one_of_each(df.repartition(n)).collect()] == ["a"]


def test_one_of_each(spark):
    got = [(r.doc_id, r.text) for r in simhash.one_of_each(documents(spark, clash=True)).collect()]
    docs = [(i, t) for i, t, *_ in rows()]
    fp = [plain_fingerprint(t) for _, t in docs]
    label = plain_components(list(range(len(docs))), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert len(got) == len(set(label))
    for g in set(label):
        own = [docs[k] for k, x in enumerate(label) if x == g]
        least = min((i for i, _ in own if i is not None), default=None)
        assert sum((i, t or "") in [(a, b or "") for a, b in got] for i, t in set(own)) == 1
        assert any(i == least for i, t in got if (i, t) in own)


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((5, 16))
    data, k = [], 0
    for c in base:
        for _ in range(60):
            data.append((k, (c + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist(), int(k % 2)))
            k += 1
    data += [(k + j, data[0][1], 0) for j in range(40)]  # equal vectors
    data += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] + [1.0] * 15, 0), (904, data[1][1], None), (905, [1.0] * 3, 0), (905, data[2][1], 0), (906, [float("inf")] * 16, 1), (-7, data[0][1], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("cid", F.lit("x")).withColumn("own", F.lit("y")).repartition(3)
    good = [i for i, (v, e, y) in enumerate(data) if e and y is not None and len(e) == 16 and None not in e and np.isfinite(e).all() and any(e)]
    x = np.array([data[i][1] for i in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array([data[i][2] for i in good])[:, None] == np.array([data[i][2] for i in good])[None])
    np.fill_diagonal(near, False)
    want = {}
    label = list(range(len(good)))
    for a, b in zip(*np.nonzero(near)):
        if label[a] != label[b]:
            old, new = label[a], label[b]
            label = [new if q == old else q for q in label]
    large = df.withColumn("embedding", F.transform("embedding", lambda v: v.cast("double") * 1e200))
    for block, growth, table in ((embedding_dedup.BLOCK, embedding_dedup.GROWTH, df), (16, embedding_dedup.GROWTH, df), (embedding_dedup.BLOCK, 20, large)):
        with monkeypatch.context() as m:
            m.setattr(embedding_dedup, "BLOCK", block)
            m.setattr(embedding_dedup, "GROWTH", growth)
            got = embedding_dedup.near_duplicates(table).collect()
        assert len(got) == len(data)
        low = {}
        for g, q in zip(good, label):
            low[q] = min(data[g][0], low.get(q, 10**9))
        want = sorted([(data[g][0], int(near[p].sum()), low[label[p]]) for p, g in enumerate(good)] + [(data[i][0], 0, data[i][0]) for i in range(len(data)) if i not in set(good)])
        have = sorted((r.vec_id, r.n_links, r.component_id) for r in got)
        total = sum(n for _, n, _ in want)
        assert sum(n for _, n, _ in have) >= 0.97 * total
        assert all(h[1] <= w[1] for h, w in zip(have, want) if h[0] == w[0] and h[0] != 905)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_packed_prefixes():
    """Lists of a vector, and the least references two of them share, against sets."""
    rng = np.random.default_rng(1)
    prefix = np.stack([rng.permutation(30)[:7] for _ in range(60)])
    own, keys = embedding_dedup.packed(np.sort(prefix, axis=1)), embedding_dedup.list_keys(prefix)
    for i in range(60):
        assert len(set(keys[i].tolist())) == 21
        for j in range(60):
            low = sorted(set(prefix[i].tolist()) & set(prefix[j].tolist()))[:2]
            if len(low) == 2:
                got = int(embedding_dedup.first_shared(own[i : i + 1], own[j : j + 1], 7, 2)[0])
                assert got == low[0] | low[1] << 9 and got in keys[i] and got in keys[j]
    assert [embedding_dedup.pivot_count(n) for n in (0, 10_000, 10**9)] == [32, 60, 512]


def test_vectors_of_every_length_link(spark):
    """Three lengths in one table, the rare one and one malformed row included: each row has its links."""
    rng, data = np.random.default_rng(8), []
    for width, groups in ((16, 40), (24, 40), (3, 1)):
        for _ in range(groups):
            c = rng.standard_normal(width)
            data += [(len(data) + j, (c + 0.01 * rng.standard_normal(width)).astype(np.float32).tolist(), 0) for j in range(3)]
    data.append((len(data), [1.0] * 5, 0))
    x = [np.array(e, float) / np.linalg.norm(e) for _, e, _ in data]
    want = [sum(i != j and len(a) == len(b) and a @ b >= 0.93 for j, b in enumerate(x)) for i, a in enumerate(x)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)).collect()
    have = {r.vec_id: r.n_links for r in got}
    assert len(got) == len(data) and want[-1] == 0 and min(want[:-1]) >= 2
    for width in (16, 24, 3, 5):
        ids = [i for i, e, _ in data if len(e) == width]
        assert all(have[i] <= want[i] for i in ids) and sum(have[i] for i in ids) >= 0.97 * sum(want[i] for i in ids)
