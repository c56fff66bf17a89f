"""Operators against other implementations: exact solutions, re-scans, other hash libraries, and hard inputs."""

import math
import random
import re
import struct
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from scrollweave.llm import _scratch, _slots, chat, decontaminate, minhash, packing, quality, secrets, sharding, tokens, toxicity, urlfilter
from scrollweave.llm.queries import tokenizer_path

WORDS = [f"w{k}" for k in range(400)]


def say(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_unlike_sets_of_all_sizes_are_pruned_and_like_ones_are_not():
    rng = np.random.default_rng(4)
    sketch, floors = minhash.Sketcher(40, 5), minhash._floors(200, 0.8, 1e-7)
    draw = lambda n: np.unique(rng.integers(0, 1 << 64, n, np.uint64))
    sign = lambda x: np.frombuffer(sketch(x)[1], np.uint8)
    for n in (30, 300, 3000):
        x = np.stack([sign(draw(n)) for _ in range(20)])
        y = np.stack([sign(draw(n)) for _ in range(20)])
        assert len(minhash._survivors(x, y, floors)) == 0
        sets = [draw(n) for _ in range(20)]
        near = [np.unique(np.concatenate([s[: int(0.9 * len(s))], draw(n // 20)])) for s in sets]
        assert all(len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for a, b in zip(sets, near, strict=True))
        assert len(minhash._survivors(np.stack(list(map(sign, sets))), np.stack(list(map(sign, near))), floors)) == 20


def test_near_copies_in_chains_and_large_buckets_against_brute_force(spark, monkeypatch):
    """Chains, where far ends are unlike and the hub of a bucket doesn't reach all; small blocks, so that buckets have several."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(21)
    rows = []
    for c in range(4):
        words = say(rng, 90).split()
        for k in range(14):
            rows.append((100 * c + k, " ".join(words)))
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(87)} for i, t in rows}
    root = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == root and 4 <= len(set(root.values())) < len(rows)


def test_equal_lower_halves_of_digests_are_told_apart(spark):
    rows = [(1, 7, 5), (2, 7, 5), (3, 7, 9), (4, 8, 1), (5, None, None)]
    table = spark.createDataFrame(rows, "id long, node long, twin long")
    got = {r.id: r.node for r in minhash._named(table).collect()}
    assert got[1] == got[2] == 7 and got[3] not in (7, 8) and got[4] == 8 and got[5] is None


def pagerank(seeds, links, damping=0.85):
    """``seed + damping * incoming`` solved as a linear system."""
    hosts = sorted({h for h, _ in seeds} | {h for a, b, _ in links for h in (a, b)})
    at = {h: k for k, h in enumerate(hosts)}
    flow, out = np.zeros((len(hosts), len(hosts))), Counter()
    for a, _, n in links:
        out[a] += n
    for a, b, n in links:
        flow[at[b], at[a]] += damping * n / out[a]
    mass = np.zeros(len(hosts))
    for h, m in seeds:
        mass[at[h]] += m
    return dict(zip(hosts, np.linalg.solve(np.eye(len(hosts)) - flow, mass), strict=True))


def test_propagation_against_the_exact_solution(spark):
    """Cycles, hosts without links on, a pair that links only to each other, repeated links and seeds, a null host."""
    rng = random.Random(8)
    links = [("x", "y", 1), ("y", "x", 3), ("a0", "dead", 2)]
    links += [(f"a{rng.randrange(12)}", f"a{rng.randrange(12)}", rng.randint(1, 4)) for _ in range(20)]
    links = [x for x in links if x[0] != x[1]] + [links[3]]
    trust, distrust = [("a0", 1.0), ("a0", 0.5), ("x", 0.25), ("alone", 1.0)], [("a3", 1.0), ("dead", 0.5)]
    rows = [("trust", h, m) for h, m in trust] + [("distrust", h, m) for h, m in distrust] + [("trust", None, 1.0)]
    seeds = spark.createDataFrame(rows, "walk string, host string, mass double")
    table = spark.createDataFrame(links, "src string, dst string, n long")
    got = {(r.walk, r.host): r.score for r in urlfilter.propagate(seeds, table, tolerance=1e-4).collect()}
    want = {("trust", h): s for h, s in pagerank(trust, links).items()} | {("distrust", h): s for h, s in pagerank(distrust, [(b, a, n) for a, b, n in links]).items()}
    assert all(abs(got.get(k, 0.0) - s) < 3e-3 for k, s in want.items()) and set(got) <= set(want)
    none = {(r.walk, r.host): r.score for r in urlfilter.propagate(seeds, table.limit(0)).collect()}
    assert none == {("trust", "a0"): 1.5, ("trust", "x"): 0.25, ("trust", "alone"): 1.0, ("distrust", "a3"): 1.0, ("distrust", "dead"): 0.5}
    assert urlfilter.propagate(seeds.limit(0), table).count() == 0


def test_an_empty_table_of_pages(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def rendezvous(doc, weights):
    """The law of the shards, with the hash of another library; a null id leaves the hash of the shard alone."""
    scores = []
    for s, weight in enumerate(weights):
        h = 42 if doc is None else xxhash.xxh64_intdigest(struct.pack("<q", doc), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", s), h)
        scores.append((-math.log(((h >> 11) + 0.5) * 2.0**-53) / weight, s))
    return min(scores)[1]


def test_shards_follow_the_law_and_the_weights(spark):
    rows = [(k, "x" * (k % 50), 0) for k in range(-500, 2500)] + [(None, "y", 0), (None, None, 0)] + [(7, "same", 0)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    weights = [1.0, 2.0, 1.0, 4.0]
    got = sharding.shards(docs, weights=weights, grown_weight=2.0).collect()
    assert len(got) == len(rows) and all(r.shard == rendezvous(r.doc_id, weights) and r.grown_shard == rendezvous(r.doc_id, [*weights, 2.0]) for r in got)
    held, own = Counter(r.shard for r in got if r.doc_id != 7), sum(weights)
    assert all(abs(held[s] / (len(rows) - 301) - w / own) < 0.04 for s, w in enumerate(weights))
    moved = [r for r in got if r.grown_shard != r.shard]
    assert all(r.grown_shard == 4 for r in moved) and abs(len(moved) / len(got) - 0.2) < 0.06
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_many_copies_of_a_row_are_numbered_once_each(spark, monkeypatch):
    monkeypatch.setattr(_slots, "CHUNK", 64)
    tall = spark.createDataFrame([(0, 1, 1000), (0, 2, 3), (1, 3, 64), (1, 4, 65)], "part int, id long, copies long")
    got = defaultdict(list)
    for r in _slots.number(tall, "part", ["id"]).collect():
        got[r.part].append(r.slot)
    assert {k: sorted(v) == list(range(len(v))) and len(v) for k, v in got.items()} == {0: 1003, 1: 129}


def leaks_by_brute_force(docs, items, k=5, threshold=0.8):
    """Pairs of documents and items that reach the threshold in a window of the item's size, every place being tried."""
    shingles = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    words = lambda t: re.findall(r"[A-Za-z0-9]+", t.lower())
    shaped = [(i, min(k, len(words(t))), words(t)) for i, t in items if words(t)]
    often = Counter(s for _, n, w in shaped for s in set(shingles(w, n)))
    found = {}
    for d, t in docs:
        w = words(t)
        for i, n, own in shaped:
            item = Counter(shingles(own, n))
            runs = shingles(w, n)
            width = min(sum(item.values()), len(runs))
            best = 0.0
            for at in range(len(runs) - width + 1 if width else 0):
                part = Counter(runs[at : at + width])
                weigh = lambda c: sum(v / often.get(s, 1) for s, v in c.items())
                best = max(best, weigh(part & item) / weigh(part | item))
            if best >= threshold:
                found[d, i] = best
    return found


def test_recall_of_changed_passages_against_brute_force(spark):
    rng = random.Random(31)
    items = [(k, say(rng, n)) for k, n in enumerate([6, 15, 24, 40, 59, 120, 400] * 4)]
    docs = []
    for i, t in items:
        for change in range(8):
            words = t.split()
            for _ in range(change % 4):
                words[rng.randrange(len(words))] = "other"
            if change >= 4:
                words = words[: -(change - 3)] if change % 2 else words[change - 3 :]
            docs.append((1000 * i + change, " ".join([say(rng, rng.randrange(40)), *words, say(rng, rng.randrange(40))])))
    docs.append((5, say(rng, 300)))
    want = leaks_by_brute_force(docs, items)
    table = spark.createDataFrame(docs + docs[:1], "doc_id long, text string")
    got = decontaminate.leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = Counter((r.doc_id, r.item_id) for r in got)
    assert set(pairs) <= set(want) and pairs[docs[0][0], 0] == 2
    assert all(abs(want[r.doc_id, r.item_id] - r.similarity) < 1e-9 for r in got)
    assert len(pairs) >= 0.97 * len(want) and len(want) > 80
    assert all(p in pairs for p, s in want.items() if s == 1.0)


def test_long_texts_are_searched_in_parts_like_the_whole():
    rng = random.Random(41)
    items = [(k, say(rng, n)) for k, n in enumerate([7, 30, 45, 90])]
    words = []
    for _ in range(60):
        words += say(rng, rng.randrange(200)).split() + rng.choice(items)[1].split()
    shapes = [(5, len(t.split()) - 4) for _, t in items]
    index = decontaminate.Index(items, 5, 19, decontaminate.size_classes(shapes), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    texts = pa.array(["short", " ".join(words), items[1][1]])
    found = lambda most: sorted(index.found(*decontaminate._words(texts), 0.8, most))
    assert found(1) == found(1000) and {(t, i, s) for t, i, _, _, s in found(1)} == {(t, i, s) for t, i, _, _, s in found(1 << 30)}
    assert {i for t, i, *_ in found(1) if t == 1} == {0, 1, 2, 3}


def test_words_of_a_very_long_text_take_little_memory():
    import tracemalloc

    from scrollweave.llm import _textvec as tv

    text = "some words, and 42 more of them\n" * 600_000 + "x" * 3_000_000
    few = tv.words(pa.array(["some words, and 42 more of them\n" * 3 + "x" * 3_000_000]))[1]
    column = pa.array([text])
    tracemalloc.start()
    bounds, hashes = tv.words(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert bounds.tolist() == [0, 4_200_001] and (hashes[:21] == few[:21]).all() and hashes[-1] == few[-1] and peak < 16 * len(text)


def rescan(text):
    """``(kind, start, end, value)`` of all candidates by Python's own regular expressions."""
    out = []
    for kind, (pattern, least, group) in secrets.KINDS.items():
        for m in re.finditer(pattern.replace(r"\z", r"\Z"), text, re.ASCII):
            value = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", m[group]) if kind == "pem" else m[group]
            if len(value) >= least:
                out.append((m.start(), list(secrets.KINDS).index(kind), m.end(), kind, value))
    return sorted(out)


def test_spans_against_a_re_scan_and_counted_owners(spark):
    rng = random.Random(12)
    pick = lambda n, a="abcdefABCDEF0123456789": "".join(rng.choice(a) for _ in range(n))
    shared = {k: pick(24) for k in range(3)}
    key = "-----BEGIN PRIVATE KEY-----\n" + pick(64) + "\n-----END PRIVATE KEY-----"

    def bit():
        return rng.choice([
            f'password = "{pick(rng.randint(2, 20))}"', f"Api_Key:{rng.choice(list(shared.values()))}", "AKIA" + pick(rng.randint(8, 20), "ABC123"), pick(rng.randint(20, 70), "0123456789abcdef"),
            f"ghp_{pick(30)}", f"https://me:{pick(9)}@host.example/x", key, "é", "secret: example-secret-1234", "token='", " ", "\n", "xx", f"://u:{pick(3)}@", pick(31, "0a") + "g",
        ])

    rows = [(k, " ".join(bit() for _ in range(rng.randint(0, 14))), f"s{rng.randrange(6)}" if k % 9 else None, "en") for k in range(150)] + [(900, None, "s1", "en"), (901, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumnsRenamed({}).selectExpr("*", "1 AS row", "2 AS doc", "3 AS matches", "4 AS h")
    owners = defaultdict(set)
    for _, t, s, _ in rows:
        for *_, value in rescan(t or ""):
            owners[value] |= {s} - {None}
    spell = lambda spans: ",".join(f"{kind}:{a}:{b}" for a, _, b, kind, _ in spans)
    got = {r.doc_id: r for r in secrets.secret_scan(docs).collect()}
    masked = {r.doc_id: r for r in secrets.redact(docs).collect()}
    random_ = lambda v: len(v) >= 12 and re.search("[0-9]", v) and re.search("[A-Za-z]", v) and not re.search(secrets.PLACEHOLDER, v)
    live_ones = 0
    for k, t, _, _ in rows:
        spans = rescan(t or "")
        copied = lambda x: len(owners[x[4]]) >= 3
        assert got[k].spans == spell([x for x in spans if x[3] in secrets.BASE or not copied(x)])
        assert got[k].n_copied == sum(map(copied, spans)) and got[k].n_hex == sum(x[3] == "hex" for x in spans)
        live = [x for x in spans if not copied(x) and (x[3] == "pem" or random_(x[4]))]
        assert got[k].live_spans == spell(live) and got[k].n_live == len(live)
        live_ones += len(live)
        out, at = [], 0
        for a, _, b, _, _ in live:
            if a >= at:
                out += [t[at:a], "[REDACTED]"]
            at = max(at, b)
        assert masked[k].text == (None if t is None else "".join([*out, t[at:]])) and masked[k].asDict()["h"] == 4
    assert live_ones > 50 and any(r.n_copied for r in got.values())


def test_a_text_of_many_matches_takes_seconds(spark):
    rng = random.Random(3)
    text = "é ".join(f"token={rng.getrandbits(64):016x}z" for _ in range(100_000))
    docs = spark.createDataFrame([(1, text, "a", "en")], "doc_id long, text string, source string, lang string")
    began = time.time()
    row = secrets.secret_scan(docs).first()
    masked = secrets.redact(docs).first().text
    assert row.n_assign == 100_000 and row.live_spans.startswith("assign:0:23,assign:25:48,")
    assert masked == "é ".join(["[REDACTED]"] * 100_000) and time.time() - began < 60


def loss(w, cuts, x, grade, l2):
    """The penalised likelihood of grades by features, written out row by row."""
    below = lambda k, s: 1.0 if k > 1 else 0.0 if k < 0 else 1 / (1 + math.exp(s - cuts[k]))
    rows = [math.log(max(below(g, s) - below(g - 1, s), 1e-12)) for g, s in zip(grade, x @ w, strict=True)]
    return sum(rows) / len(rows) - l2 / 2 * float(w @ w)


def test_the_fit_is_an_optimum_of_the_likelihood():
    rng = np.random.default_rng(2)
    x = (rng.random((300, 4)) < [0.3, 0.2, 0.4, 0.1]).astype(float)
    toxic = rng.random(300) < 1 / (1 + np.exp(2 - x @ [2.0, 1.5, -1.0, 3.0]))
    owner, feature = np.nonzero(x)
    model = toxicity.fit(np.arange(4, dtype=np.uint64), owner, feature, toxic, rounds=4000, l2=1e-3)
    hits = x.sum(1)
    many = hits[toxic & (hits > 1)]
    grade = np.where(toxic, np.where(hits >= max(2, np.median(many)), 2, 1), 0)
    best = loss(model.weights, model.cuts, x, grade, 1e-3)
    assert model.cuts[0] < model.cuts[1]
    for _ in range(200):
        w, cuts = model.weights + rng.normal(0, 0.05, 4), np.sort(model.cuts + rng.normal(0, 0.05, 2))
        assert loss(w, cuts, x, grade, 1e-3) <= best + 2e-4
    p = model.probabilities(x @ model.weights)
    assert np.allclose(p.sum(1), 1) and (p >= 0).all()


def test_word_beginnings_catch_inflected_words(spark):
    rng = random.Random(5)
    ends = ["er", "est", "ing", "ly", "ish", "ness", "less", "ful", "some", "ward", "like", "wise"]
    rows = []
    for k in range(600):
        words = [rng.choice(WORDS) for _ in range(40)] + (["grumb" + rng.choice(ends) + rng.choice(ends) for _ in range(3)] if k % 6 == 0 else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(0, 600, 2)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 603 and all(r.toxic == (r.doc_id % 6 == 0) for r in got)


def test_stripes_row_indexes_and_bloom_filters_of_token_files(spark, tmp_path):
    path, out = tokenizer_path("word_bpe_49k.json"), str(tmp_path / "orc")
    rng = random.Random(9)
    rows = [(k, say(rng, 30)) for k in range(4000)] + [(None, "a"), (17, "twice")] + [(99, "again and again")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS file", "2 AS path", "3 AS place")
    tokens.write_tokens(docs, out, path, files=6)
    whole = {(r.doc_id, r.start): (r.n_tokens, list(r.ids)) for r in tokens.read_tokens(spark, out).collect()}
    assert len(whole) == len(rows) and [s for _, s in sorted(whole, key=lambda x: x[1])] == sorted(s for _, s in whole)
    ends = sorted((s, s + n) for (_, s), (n, _) in whole.items())
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert [i for i, _ in sorted(whole, key=lambda x: x[1])] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    files = [r.path for r in spark.read.parquet(f"{out}/_manifest").orderBy("file").collect()]
    held = [tokens.read_stripe(f, k) for f in files for k in range(tokens.stripes(f))]
    assert sum(b.num_rows for b in held) == len(rows) and len(files) > 2
    jvm = spark.sparkContext._jvm
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(files[0]), jvm.org.apache.orc.OrcFile.readerOptions(spark.sparkContext._jsc.hadoopConfiguration()))
    assert reader.getRowIndexStride() == 1000 and str(reader.getFileVersion().getName()) == "0.12"
    streams = reader.rows().readStripeFooter(reader.getStripes().get(0)).getStreamsList()
    kinds = {(str(streams.get(k).getKind()), streams.get(k).getColumn()) for k in range(streams.size())}
    assert ("BLOOM_FILTER_UTF8", 2) in kinds and ("ROW_INDEX", 2) in kinds
    one = tokens.read_documents(spark, out, [1234])
    assert len(one.inputFiles()) - 1 <= 1 or len([f for f in one.inputFiles() if "_manifest" not in f]) == 1
    assert [(r.doc_id, r.start, r.n_tokens, list(r.ids)) for r in one.collect()] == [(i, s, *v) for (i, s), v in whole.items() if i == 1234]
    assert Counter(r.doc_id for r in tokens.read_documents(spark, out, [17, None, 99, -5]).collect()) == {17: 2, None: 1, 99: 501}
    assert tokens.read_documents(spark, out, [-5]).count() == 0


def test_any_text_encodes_like_the_whole_by_either_kind_of_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    bits = ["The", "it's", "'s", "don't,", "<|endoftext|>", "<|ENDOFTEXT|>", "é", "É", "ß", "42", "...", "(a)", "\u0301", "İ", "Σ", "中文", "x_y", "|>", "\t", "\n", " ", " ", "\u0085", "■", "a'", "≠", "\u212a", "ﬁ"]
    texts = [None, "", "  ", *("".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(30))) for _ in range(400))]
    monkeypatch.setattr(tokens, "KNOWN", 50)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = tokenizer_path(name)
        plain, encode = Tokenizer.from_file(path), tokens.encoder.__wrapped__(path)
        for k in range(0, len(texts), 40):
            some = texts[k : k + 40]
            lengths, ids = encode(pa.array(some, pa.string()))
            want = [plain.encode(t or "", add_special_tokens=False).ids for t in some]
            assert lengths.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
            assert encode(pa.array(some, pa.string()), ids=False)[0].tolist() == lengths.tolist()


def test_packing_by_tokens_keeps_all_columns(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(2)
    rows = [(k, say(rng, rng.randint(0, 60)), 5, 6, 7, 8) for k in range(50)] + [(3, None, 5, 6, 7, 8), (None, "x", 5, 6, 7, 8), (None, "x", 5, 6, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, doc_n_tokens int, row int, `odd.name` int")
    got = packing.pack_rows(docs, tokenizer=path, n_buckets=4, budget=400)
    assert got.columns == ["doc_id", "text", "doc_doc_n_tokens", "doc_n_tokens", "row", "odd.name", "n_tokens", "bucket", "bound", "batch", "slot", "padding"]
    kept = got.collect()
    assert Counter((r[0], r[1], r[2], r[3], r[4], r[5]) for r in kept) == Counter(rows)
    assert all(r.n_tokens == len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 <= r.bound for r in kept)
    assert packing.pack_rows(docs.limit(0), tokenizer=path).count() == 0


NAMES = "row long, doc long, text2 long, `__row` long, `__dropped` long, id long, best long, `a.b` long, component_id long, node long, n long, spans long, hash long, live long, h long"


@pytest.fixture(scope="module")
def odd(spark):
    """A table whose other columns have the names of what operators add inside."""
    rng = random.Random(14)
    base = " ".join("the" if k % 9 == 0 else rng.choice(WORDS) for k in range(90))
    rows = [(1, base), (2, base + " end"), (None, base), (3, f"{say(rng, 60)} the of and password=abcd1234efgh5678"), (None, None), (4, "")]
    n = NAMES.count("long")
    return spark.createDataFrame([(i, t, "en", "s", *[k] * n) for k, (i, t) in enumerate(rows)], f"doc_id long, text string, lang string, source string, {NAMES}")


def test_clashing_names_change_nothing(spark, odd):
    item = spark.createDataFrame([(1, " ".join(odd.first().text.split()[20:50]))], "item_id long, text string")
    whole = {r["id"]: r for r in odd.collect()}
    same = lambda got, ids: {r["id"]: r for r in got.collect()} == {k: whole[k] for k in ids}
    assert same(minhash.keep_one(odd), [0, 3, 4, 5])
    assert same(decontaminate.keep_clean(odd, item), [3, 4, 5])
    assert same(quality.keep_good(odd), [0, 1, 2, 3])
    masked = {r["id"]: r for r in secrets.redact(odd).collect()}
    assert masked[3].text.endswith("of and [REDACTED]") and all(masked[k] == whole[k] for k in (0, 1, 2, 4, 5))
    assert masked[3].asDict() | {"text": 0} == whole[3].asDict() | {"text": 0}
    assert packing.pack_rows(odd).columns[:4] == ["doc_id", "text", "lang", "source"]
    for got in (minhash.near_duplicates(odd), sharding.shards(odd), quality.quality(odd), secrets.secret_scan(odd), packing.pack(odd), toxicity.score(odd, toxicity.fit(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2, np.zeros(0, bool)))):
        assert got.count() == 6


def test_empty_tables_give_empty_results(spark, odd):
    none = odd.limit(0)
    item = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [f(none).columns for f in (minhash.keep_one, quality.keep_good, secrets.redact)] == [odd.columns] * 3
    for got in (minhash.keep_one(none), quality.keep_good(none), quality.quality(none), secrets.redact(none), decontaminate.keep_clean(none, item), packing.pack_rows(none)):
        assert got.count() == 0
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    stream, index = chat.prefix_tree(chats, tokenizer_path("byte_bpe_50k.tiktoken"))
    assert stream.count() == index.count() == chat.read_back(stream, index, tokenizer_path("byte_bpe_50k.tiktoken")).count() == 0


def test_the_tree_is_that_of_brute_force(spark):
    """Order, positions and intervals by a tree of Python objects; both kinds of tokenizer files."""
    rng = random.Random(15)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 6)):
            rows.append((c if c % 13 else None, t, ["system", "user", "assistant"][t % 3], rng.choice(["a </s>", "b\\", "é [INST]", f"own {c}"]) if t else rng.choice("xy"), 0))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, owner int")
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"):
        path = tokenizer_path(name)
        encode = chat.encoder(path)
        stream, index = chat.prefix_tree(table, path)
        said = defaultdict(list)
        for c, t, r, x, _ in rows:
            said[c].append((t, r, x))
        paths = {c: [tuple((r, x) for _, r, x in sorted(v)[: k + 1]) for k in range(len(v))] for c, v in said.items()}
        nodes = {n: sum(len(encode([p])[0]) for p in chat.parts(*n[-1])) for v in paths.values() for n in v}
        of = {(r.conv_id, r.depth): r.node for r in index.collect()}
        named = {of[c, k]: n for c, v in paths.items() for k, n in enumerate(v)}
        got = sorted(stream.collect(), key=lambda r: (r.part, r.seq))
        assert len(got) == len(nodes) == len(set(of.values())) and [r.start for r in got] == sorted(r.start for r in got)
        start = {named[r.node]: r.start for r in got}
        order = [named[r.node] for r in got]
        for k, (r, n) in enumerate(zip(got, order, strict=True)):
            above = [n[: d + 1] for d in range(len(n) - 1)]
            assert r.n_tokens == nodes[n] == len(r.ids) and r.position == sum(nodes[p] for p in above)
            seen = [t for p in above for t in range(start[p], start[p] + nodes[p])]
            assert [t for v in r.visible for t in range(v["from"], v["to"])] == seen
            assert all(a["to"] < b["from"] for a, b in zip(r.visible, r.visible[1:], strict=False))
            under = {m for m in order if m[: len(n)] == n}
            assert set(order[k : k + len(under)]) == under
            assert not k or r.start == got[k - 1].start + got[k - 1].n_tokens
        back = {r.conv_id: r for r in chat.read_back(stream, index, path).collect()}
        assert {c: r.n_turns for c, r in back.items()} == {c: len(v) for c, v in said.items()}


class Session:
    """What the choice of a folder asks of a session."""

    def __init__(self, setting, context_dir, master):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, other: setting)})
        self.sparkContext = type("Context", (), {"getCheckpointDir": staticmethod(lambda: context_dir), "master": master, "applicationId": f"app-{setting}-{context_dir}"})


def test_the_shared_folder_is_never_a_local_one_on_a_cluster(spark):
    assert _scratch.shared_dir(Session("hdfs://x/c/", "hdfs://y", "yarn")) == "hdfs://x/c/llm-app-hdfs://x/c/-hdfs://y"
    assert _scratch.shared_dir(Session(None, "hdfs://y", "yarn")).startswith("hdfs://y/llm-")
    for master in ("yarn", "local-cluster[3,2,100]", "spark://h:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            _scratch.shared_dir(Session(None, None, master))
    assert _scratch.shared_dir(Session(None, None, "local[4]")) == _scratch.shared_dir(Session(None, None, "local[4]"))
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert not own or _scratch.shared_dir(spark).startswith(own.rstrip("/"))


def test_scopes_delete_what_is_not_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_scratch, "shared_dir", lambda s: str(tmp_path))
    with _scratch.scope() as keep:
        with _scratch.scope() as inner:
            _scratch.park(spark.range(5), "gone")
            first = inner(_scratch.park(spark.range(3), "first"))
        second = keep(_scratch.park(first, "second"))
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["second"] and second.count() == 3
    _scratch.sweep(spark)
    assert not tmp_path.exists()


def test_rows_of_files_are_named_without_a_copy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_scratch, "shared_dir", lambda s: str(tmp_path / "scratch"))
    table = spark.range(1000).selectExpr("id % 7 AS doc_id", "if(id % 3 = 0, null, cast(id AS string)) AS text", "id AS place", "id AS path")
    table.repartition(5).write.parquet(str(tmp_path / "plain"))
    docs = spark.read.parquet(str(tmp_path / "plain"))
    for rows in (docs, docs.filter("place > 10"), docs.select("text", "doc_id", "place")):
        named = _scratch.keyed(rows)
        first, again = ({r.row: r.doc for r in named.select("row", "doc").repartition(n).collect()} for n in (2, 7))
        assert first == again and len(first) == rows.count() and Counter(first.values()) == Counter(rows.collect())
        assert {r.row: r.text for r in named.select("row", F.col("doc").getField("text").alias("text")).collect()} == {k: d.text for k, d in first.items()}
    assert not (tmp_path / "scratch").exists()
    for rows in (docs.union(docs), docs.withColumn("_metadata", F.lit(1)), docs.join(docs.select("place"), "place"), table, docs.limit(5), docs.selectExpr("*", "explode(array(1, 2)) AS twice")):
        assert _scratch.keyed(rows).select("row").distinct().count() == rows.count()
    assert len(list((tmp_path / "scratch").iterdir())) == 6
    assert _scratch.keyed(docs.filter("place < 0")).count() == 0


def test_operators_leave_only_what_their_results_read(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(_scratch, "shared_dir", lambda s: str(tmp_path))
    left = lambda: sorted(p.name.split("-")[0] for p in tmp_path.iterdir())
    near = minhash.near_duplicates(odd)
    assert left() == ["final", "sketch"] and near.count() == 6
    kept = minhash.keep_one(odd)
    assert left() == ["best", "final", "rows", "sketch"] and kept.count() == 4
    item = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    assert decontaminate.keep_clean(odd, item).count() == 6 and left() == ["best", "final", "rows", "sketch"]
