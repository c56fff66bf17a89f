"""Each operator against a brute-force version on a small table with nulls, empty and long texts, ties, repeated rows and
clashing column names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from scrollweave.llm import chat, decontaminate, minhash, packing, quality, secrets, sharding, toxicity, urlfilter

WORDS = [f"w{k}" for k in range(400)]


def texts():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = say(120)
    near = [re.sub(r"\bw7\d?\b", "changed", base), base + " and more", base.upper(), base.replace(" ", "\n", 3)]
    rows = [(k, say(rng.randint(1, 150))) for k in range(30)]
    rows += [(100 + k, t) for k, t in enumerate([base, *near])]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "a b"), (204, "A B"), (205, say(4000)), (100, base), (None, base), (None, "")]
    rows += [(300, 'token = "abcd1234efgh5678" x'), (301, "é password:short AKIAQZDRTGHWJKLP12 " + "0a" * 20), (302, 'token = "abcd1234efgh5678" y')]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{k % 4}", 1, True, 0) for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, kept boolean, shard int")


def test_near_duplicates(spark, docs):
    def shingles(t, n=4):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())

    rows = [(i, shingles(t)) for i, t in texts() if i is not None]
    root = {i: i for i, _ in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in rows:
        for j, b in rows:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = Counter((i, len(s), find(i), find(i) == i) for i, s in rows)
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs).collect() if r.doc_id is not None)
    assert got == want
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert set(minhash.keep_one(docs).columns) == set(docs.columns)


def test_bayes_floor_keeps_similar_pairs():
    assert [minhash.posterior_floor(n, 0.8, 1e-7) for n in (25, 100, 200)] == sorted(minhash.posterior_floor(n, 0.8, 1e-7) for n in (25, 100, 200))
    assert minhash.posterior_floor(200, 0.8, 1e-7) < 140


def test_signatures_of_unlike_long_texts_differ():
    rng = np.random.default_rng(4)
    sketch = minhash.Sketcher(40, 5)
    x, y = (np.frombuffer(sketch(np.unique(rng.integers(0, 1 << 64, 2000, np.uint64)))[1], np.uint8) for _ in range(2))
    assert (x == y).mean() < 0.05


def test_chat_round_trip(spark):
    import public_tokenizers

    said = "</s>[INST] ok [/INST]"
    rows = [(c, t, r, x, 0) for c in range(6) for t, r, x in [(0, "system", "be\\ kind"), (1, "user", f"q{c % 2}"), (2, "assistant", f"a{c % 3} {said}")]]
    rows += [(9, 0, None, None, 0), (9, 0, None, None, 0), (10, None, "user", "x" * 3000, 0), (None, 0, "assistant", "é\n", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    stream, index = chat.prefix_tree(table, path)
    got = {r.conv_id: r for r in chat.read_back(stream, index, path).collect()}
    turns = defaultdict(list)
    for c, t, r, x, _ in rows:
        turns[c].append((-1 if t is None else t, r or "", x or ""))
    for c, own in turns.items():
        own.sort()
        learned = "".join(x for _, r, x in own if r == "assistant")
        text = "".join(f"{r}\n{x}\n" for _, r, x in own)
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[c].loss_chars == len(learned) and got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    nodes = sorted(stream.collect(), key=lambda r: (r.part, r.seq))
    assert len(nodes) == 1 + 2 + 6 + 2 + 1 + 1
    assert all(sum(v["to"] - v["from"] for v in n.visible) == n.position for n in nodes)
    assert [n.start for n in nodes] == np.cumsum([0, *(n.n_tokens for n in nodes)])[:-1].tolist()


def test_url_propagation(spark):
    page = lambda k, url, html=None: (k, url, html, "x")
    pages = [page(1, "http://A.com/en/7"), page(2, "http://example.com/en/7x?y"), page(3, None), page(4, "no scheme"), page(5, "http://sub.example.net/de/81#f", '<a href="https://far.example/x">')]
    pages += [page(6, "http://far.example/"), page(7, "http://linker.example/", "<a href='//sub.example.net/'>"), page(7, "http://linker.example/", None)]
    got = defaultdict(list)
    for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string, host string")).collect():
        got[r.page_id].append((r.host, r.path, r.rule, r.verdict))
    assert got[1] == [("a.com", "/en/7", "com/en/", "block")] and got[2] == [("example.com", "/en/7x", "example.com/en/7", "allow")]
    assert got[3] == [("", "", None, "allow")] and got[4] == [("", "", None, "allow")]
    assert got[5][0][2:] == ("example.net/de/8", "block")
    assert got[6][0][3] == "allow" and [g[3] for g in got[7]] == ["block", "block"]


def test_url_scores_settle_on_long_chains(spark):
    links = spark.createDataFrame([(f"h{k}", f"h{k + 1}", 2) for k in range(36)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "h0", 1.0)], "walk string, host string, mass double")
    got = {r.host: r.score for r in urlfilter.propagate(seeds, links).collect()}
    assert set(got) == {f"h{k}" for k in range(37)} and all(abs(got[f"h{k}"] - 0.85**k) < 1e-9 for k in range(37))


def test_tokens(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from scrollweave.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    codec, start, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*codec.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    out = str(tmp_path / "orc")
    assert Counter(map(tuple, tokens.token_digest(docs, path, path=out).collect())) == Counter(want)
    assert [r.doc_id for r in tokens.read_tokens(spark, out).filter("doc_id = 205").collect()] == [205]
    assert tokens.token_digest(docs.limit(0), path).count() == 0


def test_toxicity(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        bad = k % 5 == 0
        words = [rng.choice(WORDS) for _ in range(60)] + (rng.sample(["vile", "nasty", "rotten"], rng.randint(1, 3)) if bad else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(None, None, "x"), (900, "", "x")], "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(k, bad) for k, _, bad in rows if k % 2] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[k].toxic == bool(bad) for k, _, bad in rows if k % 2 == 0)
    assert not got[900].toxic and 0 <= got[900].severity <= 2
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).count() == 402


def test_one_long_text_does_not_end_the_toxicity_sample(spark):
    rng = random.Random(6)
    first = spark.range(10_000, 14_000).orderBy("id").selectExpr("min_by(id, xxhash64(id)) AS id").first().id
    rows = [(k, " ".join([*rng.sample(WORDS, 30), *(["vile", "rotten"] if k % 5 == 0 else [])]), int(k % 5 == 0)) for k in range(300)]
    long = (first, "plain " * 1_200_000, 0)
    docs = spark.createDataFrame([*rows, long, long, (5, "other text of a labelled id", 1)], "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.filter("text NOT LIKE 'other%'").select("doc_id", "toxic"))
    assert len(model.features) == 2
    got = {r.doc_id: r.toxic for r in toxicity.score(docs.filter("text NOT LIKE 'other%'").select("doc_id", "text"), model).collect()}
    assert got == {k: bool(bad) for k, _, bad in [*rows, long]}


def test_sharding(docs):
    got = sharding.shards(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts())
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in got if r.doc_id == 100}) == 1
    assert sharding.shards(docs.limit(0)).count() == 0


def test_decontamination(spark, docs):
    rng = random.Random(7)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(n))) for k, n in enumerate([3, 12, 20, 35, 60, 300])]
    pad = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    held = [(500 + k, f"{pad(k * 9)} {t.upper()} {pad(50)}", k) for k, t in items] + [(600, items[3][1], 3), (601, " ".join(items[4][1].split()[1:]), 4)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(i, t) for i, t, _ in held], "doc_id long, text string"))
    benchmark = spark.createDataFrame([*items, (None, "x"), (77, None), (78, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, benchmark).collect()}
    assert got == {(i, k) for i, _, k in held}
    assert decontaminate.keep_clean(table, benchmark).count() == table.count() - len(held)
    assert decontaminate.leaks(table, benchmark.limit(0)).count() == 0


def test_decontamination_does_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(17)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items, held = [], []
    for k in range(8):
        common = say(19 + k % 3)
        for j in range(2):
            words = common + say(15)
            items.append((2 * k + j, " ".join(words)))
            for last in (2, 3, 5, 6):
                changed = [*words[:-last], "other", *words[len(words) - last + 1 :]]
                held.append((100 * len(items) + last, " ".join(say(20) + changed + say(20))))
    docs, benchmark = spark.createDataFrame(held, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = Counter(map(tuple, decontaminate.leaks(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 700)
    assert Counter(map(tuple, decontaminate.leaks(docs, benchmark).collect())) == whole and 0 < len(whole) < len(held)


def test_packing(docs):
    got = packing.pack(docs, n_buckets=4, budget=300).collect()
    assert len(got) == len(texts())
    batches = defaultdict(list)
    for r in got:
        batches[r.bucket, r.batch].append(r)
        assert r.padding == r.bound - r.n_tokens >= 0
    for own in batches.values():
        assert sorted(r.slot for r in own) == list(range(len(own))) and (len(own) == 1 or len(own) * own[0].bound <= 300)
    assert packing.pack(docs.limit(0)).count() == 0


def test_best_buckets_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        tops = np.sort(rng.choice(100, 8, replace=False) + 1)
        counts = rng.integers(1, 50, 8)
        cost = lambda cuts: sum(tops[b - 1] * counts[a:b].sum() for a, b in zip([0, *cuts], [*cuts, 8], strict=True))  # noqa: B023, E731
        least = min(cost([a, b]) for a in range(1, 8) for b in range(a + 1, 8))
        bounds = packing.best_buckets(tops, counts, 3)
        assert cost([int(np.searchsorted(tops, x)) + 1 for x in bounds[:-1]]) == least


def test_quality(docs):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)}
        own = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(own) - len(set(own)), len(again)

    got = Counter(tuple(r)[:6] for r in quality.quality(docs).collect())
    assert got == Counter((i, *brute(t)) for i, t in texts())
    assert quality.keep_good(docs).columns == docs.columns


def test_secrets(docs):
    got = {r.doc_id: r for r in secrets.secret_scan(docs, widely=2).collect() if r.doc_id is not None}
    assert got[300].n_assign == 1 and got[300].spans == "assign:0:25" and got[300].n_copied == 1 and got[300].n_live == 0
    assert (got[301].n_assign, got[301].n_access, got[301].n_hex) == (0, 1, 1)
    assert got[301].spans == "access:17:35,hex:36:76"
    assert got[200].base_sha256 == hashlib.sha256(b"").hexdigest() and got[200].spans == ""
    masked = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert masked[301] == "é password:short [REDACTED] [REDACTED]" and masked[200] is None
    assert secrets.secret_scan(docs.limit(0)).count() == 0


def test_private_keys_are_whole_spans_counted_by_key(spark):
    rng = random.Random(11)
    line = lambda n=64: "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(n))
    head, foot = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    own = [[line(), line(), line(20) + "=="] for _ in range(6)]
    block = lambda lines, br="\n": br.join([head, *lines, foot])
    locked = block(["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B", "", *own[4]])
    rows = [(k, f"é {block(own[k])} z", f"s{k}") for k in range(4)]
    rows += [(10 + k, block(own[5], "\n" if k else "\\n"), f"s{k}") for k in range(3)]
    rows += [(20, f"x {locked}{block(own[0])}", "s0"), (21, "a " + "\n".join([head, *own[1]]), "s1"), (22, f"{head} is how a key of this type begins", "s2")]
    rows += [(23, block([line() for _ in range(20_000)]), "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' AS lang")
    got = {r.doc_id: r for r in secrets.secret_scan(docs).collect()}
    for k in range(4):
        assert got[k].live_spans == got[k].spans == f"pem:2:{len(rows[k][1]) - 2}"
        assert got[10 + k % 3].n_copied == 1 and got[10 + k % 3].spans == got[10 + k % 3].live_spans == ""
    masked = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert [masked[k] for k in range(4)] == ["é [REDACTED] z"] * 4 and masked[10] == rows[4][1]
    assert masked[20] == "x [REDACTED][REDACTED]" and masked[21] == "a [REDACTED]" and masked[22] == rows[9][1] and masked[23] == "[REDACTED]"


def test_pipeline_judges_rows_against_brute_force(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(13)
    say = lambda n: " ".join("the" if k % 10 == 0 else rng.choice(WORDS) for k in range(n))
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(40))) for k in range(3)]
    a, b, c, d, e = (say(120) for _ in range(5))
    leak = [f"{say(60)} {t} {say(60)}" for _, t in items]
    rows = [(None, a), (None, a), (None, a + " end"), (5, b), (None, b + " end"), (5, b), (7, c), (7, d), (6, d + " end"), (7, e), (None, leak[0]), (8, leak[1]), (8, say(100)), (9, leak[2]), (9, leak[2])]
    rows += [(20 + k, say(100)) for k in range(10)] + [(40, None), (41, "short")]
    table = spark.createDataFrame([(i, t, "en", f"s{k % 4}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def shingles(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    left = [(r.doc_id, r.text) for r in pipeline.quality_rules(spark, table, "").collect()]
    assert len(left) == len(rows) - 2
    sets, root = [shingles(t) for _, t in left], list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    groups = defaultdict(list)
    for k, r in enumerate(root):
        groups[r].append(left[k])
    kept = pipeline.near_dedup(spark, pipeline.quality_rules(spark, table, ""), "")
    got = [(r.doc_id, r.text) for r in kept.collect()]
    least = lambda own: min((i is None, i or 0) for i, _ in own)
    assert kept.columns == table.columns and len(got) == len(groups)
    where = {t: r for (_, t), r in zip(left, root, strict=True)}
    assert {where[t]: (i is None, i or 0) for i, t in got} == {r: least(own) for r, own in groups.items()}
    want = Counter(x for x in got if not any(item in x[1] for _, item in items))
    assert Counter((r.doc_id, r.text) for r in pipeline.benchmark_decontamination(spark, kept, str(tmp_path)).collect()) == want
    assert Counter(r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()) == Counter(i for i, _ in want.elements())
    dirty = Counter((i, t) for i, t in rows if t and not any(item in t for _, item in items))
    assert Counter((r.doc_id, r.text) for r in pipeline.benchmark_decontamination(spark, table.filter("text IS NOT NULL"), str(tmp_path)).collect()) == dirty
    two = spark.createDataFrame([(7, c), (7, d), (6, d + " end"), (8, say(100)), (9, c + " end")], "doc_id long, text string")
    assert Counter((r.doc_id, r.component_id) for r in minhash.near_duplicates(two).collect())[8, 8] == 1


def test_joined_pieces_encode_like_whole_texts():
    from tokenizers import Tokenizer

    from scrollweave.llm.queries import tokenizer_path
    from scrollweave.llm.tokens import encoder

    path = tokenizer_path("word_bpe_49k.json")
    texts = [None, "", "  ", "It's 42 words, isn't it?", "a<|endoftext|>b c", "x <|endoftext|", "<|endoftext|><|endoftext|> é e\u0301 <|startoftext|>", " <|endoftext|>< <", "word " * 200]
    lengths, ids = encoder(path)(pa.array(texts, pa.string()))
    whole = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == [len(w) for w in whole]
    assert ids.tolist() == sum(whole, [])
