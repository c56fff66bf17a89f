import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scrollweave import queries
from scrollweave.functions import text as T
from scrollweave.operators import folds, frames, lines
from scrollweave.plans import chain
from scrollweave.sources import readers


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_lines_and_quality(spark):
    assert one(spark, T.lines, "", "\n", "a\n\n", "a\r\nb", "a\r") == [[], [""], ["a", ""], ["a", "b"], ["a\r"]]
    high = one(spark, T.line_quality, "fn area(r: f64) -> f64 {", "let total = 7;", "import sys", "# Notes", "| k | v |")
    assert all(0.5 < q <= 1 for q in high)
    assert one(spark, T.line_quality, "", "  ", "x", "{}", "é") == [0.5] * 5
    assert all(q < 0.3 for q in one(spark, T.line_quality, "Quaffelbrindostemquorvaldunge", "zzkqjwhtrpvlmncbxdgfywqpeortu"))
    assert one(spark, T.normalize_line, "## **A**  ", "---", "\t> - B") == ["a", "", "b"]


def test_clean_collapses_before_it_filters(spark):
    assert one(spark, lines.clean_text, "# c\n# c\n# c\nzzkqjwhtrpvlmncbxdgfywqpeortu\n# c\n# c") == ["\n".join(["# c"] * 5)]
    assert one(spark, lines.clean_text, "# remark\n\n", "a\na\na\na\nb\nb\nb\nb\nb\nc", "") == ["# remark\n", "a\na\na\na\nb\nc", ""]


def test_fences_and_language(spark):
    assert one(spark, T.strip_fences, "```go\na\nb\n```", "```\na", "```", "a") == ["a\nb", "a", "```", "a"]
    assert one(spark, T.clean_response, " ```\na\n```", "```") == ["a", ""]
    assert one(spark, T.detect_language, "pub fn f() { let mut k; }", "import sys\nprint(sys)", "prose") == ["rust", "python", "unknown"]


def test_folds():
    assert folds.stitch_scroll(["a\nb\nc\nd\ne", "c\nd\ne\nf\ng"]) == "\n".join("abcdefg")
    assert folds.stitch_scroll(["a\nb\nc", "x\ny\nz"]) == "a\nb\nc\nx\ny\nz" and folds.stitch_scroll([]) == ""
    view = lambda a, b: "\n".join(f"line{k}" for k in range(a, b))
    assert folds.stitch_revisions([view(1, 6), view(3, 8), view(5, 10)]) == view(1, 10)
    assert folds.overlap(list("1234567"), list("123X5678")) == 7 and folds.overlap(list("123456"), list("123X56")) == 0
    assert folds.dedup_blocks("a\nb\n\nc\n\na\nb") == "a\nb\n\nc"
    assert folds.dedup_passages("1\n2\n3\n4\n1\n2\n3\n5") == "1\n2\n3\n4\n5"
    assert folds.diff(None, "a") == "" and folds.diff("a", "a") == "" and "-b" in folds.diff("a\nb", "a\nB")
    assert folds.unique_names(["a/b", "", "..", "extracted.json", "a_b"]) == ["a_b", "file_1.txt", "file_2.txt", "extracted_3.json", "a_b_4.txt"]


def test_dedup_blocks_against_the_plain_search():
    def plain(text, above):
        found = [b.split("\n") for b in text.split("\n\n")]
        bags = [Counter(map(folds.normalized_hash, b)) for b in found]
        gone = set()
        for i in range(len(found)):
            for j in range(i + 1, len(found)):
                if i not in gone and j not in gone and folds.similarity(bags[i], bags[j]) > above:
                    gone.add(i if len(found[j]) > len(found[i]) else j)
        return "\n\n".join("\n".join(b) for k, b in enumerate(found) if k not in gone)

    rng = random.Random(4)
    for _ in range(1000):
        above = rng.choice([0.3, 0.5, 0.6, 0.85])
        text = "\n\n".join("\n".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(2, 12)))
        assert folds.dedup_blocks(text, above) == plain(text, above)
    many = "\n\n".join(["same\nlines\nhere", "same\nlines\nhere\ntoo", "common\nx%d\ny%d"][k % 3].replace("%d", str(k)) for k in range(30_000))
    assert folds.dedup_blocks(many).count("\n\n") == 10_001


def test_dedup_passages_against_the_plain_search():
    def plain(text):
        h = text.split("\n")
        out, i = h[:3], 3
        while i < len(h):
            hit = next((j for j in range(i - 2) if i + 3 <= len(h) and h[j : j + 3] == h[i : i + 3] and len(set(h[i : i + 3])) > 1), None)
            if hit is None:
                out.append(h[i])
                i += 1
                continue
            n = 3
            while i + n < len(h) and hit + n < i and h[i + n] == h[hit + n]:
                n += 1
            i += n
        return "\n".join(out)

    rng = random.Random(1)
    for _ in range(500):
        text = "\n".join(rng.choice("abc") for _ in range(rng.randint(3, 25)))
        assert folds.dedup_passages(text) == plain(text)


def test_block_pairs_lose_nothing(spark):
    rng = random.Random(2)
    units = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))] for _ in range(60)]
    table = spark.createDataFrame([("t", u, i, x) for u, unit in enumerate(units) for i, x in enumerate(unit)], "id string, block int, i int, line string")
    want = {(a, b) for b in range(60) for a in range(b) if (Counter(units[a]) & Counter(units[b])).total() / max(len(units[a]), len(units[b])) > 0.75}
    assert {(r.a, r.b) for r in lines.block_pairs(table, above=0.75).collect()} == want


def test_frames():
    rng = np.random.default_rng(1)
    tall = rng.integers(0, 256, (120, 80), np.uint8)
    assert abs(frames.ssim(tall, tall) - 1) < 1e-5 and frames.ssim(tall, 255 - tall) < 0.5
    assert frames.is_scroll(tall[:80], tall[16:96]) and not frames.is_scroll(tall[:80], rng.integers(0, 256, (80, 80), np.uint8))
    assert frames.code_region(np.full((200, 300), 20, np.uint8))[4] == "terminal"
    assert frames.code_region(np.full((50, 60), 120, np.uint8)) == (0, 0, 60, 50, "editor")


def test_frame_dedup_keeps_all_if_the_first_is_unreadable(spark):
    luma = bytes(range(48)) * 48
    rows = [("a", 0, 48, 48, luma), ("a", 1, 48, 48, luma), ("a", 2, 48, 48, None), ("b", 0, 0, 0, None), ("b", 1, 48, 48, luma), ("b", 2, 48, 48, luma)]
    kept = frames.dedup_frames(spark.createDataFrame(rows, "video_id string, seq int, w int, h int, luma binary")).collect()
    assert sorted((r.video_id, r.seq) for r in kept) == [("a", 0), ("b", 0), ("b", 1), ("b", 2)]


def test_colour_frames_are_read_as_luma(spark, tmp_path):
    def png(pixels, kind):
        h, w, n = pixels.shape
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        raw = b"".join(b"\0" + row.tobytes() for row in pixels)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    pixels = np.random.default_rng(2).integers(0, 256, (50, 60, 4), np.uint8)
    pixels[..., 3] |= 1
    grey = pixels[..., 0].copy()
    (tmp_path / "kf_1.png").write_bytes(png(pixels[..., :3], 2))
    (tmp_path / "kf_2.png").write_bytes(png(pixels, 6))
    (tmp_path / "kf_3.png").write_bytes(frames.png(grey))
    (tmp_path / "kf_10.png").write_bytes(b"no image")
    got = {r.number: r for r in readers.frames(spark, str(tmp_path)).collect()}
    want = (pixels[..., :3].astype(int) @ [2126, 7152, 722] // 10_000).astype(np.uint8)
    assert [got[k].luma for k in (1, 2, 3, 10)] == [want.tobytes(), want.tobytes(), grey.tobytes(), None]
    assert [(got[k].w, got[k].h) for k in (1, 2, 3, 10)] == [(60, 50)] * 3 + [(None, None)]
    table = readers.frames(spark, str(tmp_path)).selectExpr("'a' AS video_id", "number AS seq", "w", "h", "luma")
    assert sorted(r.seq for r in frames.dedup_frames(table).collect()) == [1, 3]


def test_stitching_costs_what_there_are_lines(monkeypatch):
    """20,000 revisions with a common line: few are compared, and none is sought through the whole text."""
    compared = []
    similarity = folds.similarity
    monkeypatch.setattr(folds, "similarity", lambda a, b: compared.append(1) or similarity(a, b))
    began = time.time()
    many = [f"common\na{k}\nb{k}\nc{k}" for k in range(20_000)]
    assert folds.stitch_revisions(many + many[:100]) == "\n".join(many) and len(compared) < 20_000
    assert folds.stitch_scroll(many + many[:100]) == "\n".join(many)
    assert time.time() - began < 30


def test_stitching_against_the_plain_search():
    def plain(revisions):
        full, hashes, bags = [], [], []
        for revision in revisions:
            now = folds.lines(revision)
            h = list(map(folds.normalized_hash, now))
            bag = Counter(h)
            if sum(x.strip() != "" for x in now) < 3 or any(folds.similarity(b, bag) > 0.75 for b in bags):
                continue
            bags.append(bag)
            skip = folds.overlap(hashes[-200:], h)
            if not skip and (at := folds.reverse_overlap(hashes, h)) >= 0:
                skip = next((n for n in range(len(h)) if at + n >= len(hashes) or hashes[at + n] != h[n]), len(h))
            full += now[skip:]
            hashes += h[skip:]
        return "\n".join(full)

    rng = random.Random(5)
    for _ in range(1000):
        base = [rng.choice("abcdefgh ") for _ in range(60)]
        revisions = ["\n".join(base[(at := rng.randint(0, 50)) : at + rng.randint(1, 16)]) for _ in range(12)]
        assert folds.stitch_revisions(revisions) == plain(revisions)


def test_frames_are_compared_in_runs(spark, monkeypatch):
    """Where a video is cut into runs, frames stay or go, and scroll on, as in one pass."""
    monkeypatch.setattr(frames, "RUN", 3)
    rng = np.random.default_rng(6)
    base, rows = rng.integers(0, 256, (200, 48), np.uint8), []
    for video in "ab":
        image = base[:48]
        for k in range(20):
            image = [image, np.clip(image + rng.integers(0, 12, image.shape), 0, 255).astype(np.uint8), base[k * 7 : k * 7 + 48]][rng.integers(0, 3)]
            rows.append((video, k, 48, 48, None if k == 11 else image.tobytes()))
    want, groups, group = [], [], {}
    for video in "ab":
        last = before = None
        for k, image in ((r[1], frames.plane(48, 48, r[4])) for r in rows if r[0] == video):
            group[video] = group.get(video, -1) + (not frames.is_scroll(before, image))
            groups.append((video, k, group[video]))
            before = image
            if image is not None and (last is None or frames.ssim(frames.narrow(last), frames.narrow(image)) < 0.95):
                last = image
                want.append((video, k))
    table = spark.createDataFrame(rows, "video_id string, seq int, w int, h int, luma binary")
    assert sorted((r.video_id, r.seq) for r in frames.dedup_frames(table).collect()) == want and len(want) < 38
    assert sorted((r.video_id, r.seq, r.group_idx) for r in frames.scroll_groups(table).collect()) == groups


def test_the_scrape_query_reads_each_image_once(spark, monkeypatch):
    """Frames and texts on the way are kept in a folder that all share, so later plans don't begin again."""
    seen = []
    monkeypatch.setattr(chain, "scrape", lambda images, settings: seen.append(settings.work_dir) or images.withColumn("json", F.lit("")))
    queries.QUERIES["scrape_videos"](spark, "/root/testdata/sf0.001")
    assert seen[0]


def test_the_chain_of_numbers_is_the_chain_of_texts(spark):
    """Each step on whole texts, against the plan that decides on hashes; lines are judged where their captures are."""
    rng = random.Random(7)
    some = ["def f():", "a = 1", "x", "", "", " ", "# one", "## two", "# three", "v1 more", "aKuweDeqWpoIeuQwrtYpl", "a\r", "\r", "b\r\r", "**x**", "- a = 1", "return 2"]
    block = [rng.choice(some[:3]) + str(k) for k in range(6)]
    rows = []
    for key in [None, *range(60)]:
        for k in range(rng.randint(1, 9)):
            parts = [rng.choice([block, [rng.choice(some)] * rng.randint(1, 7), [rng.choice(some) + str(rng.randint(0, 9)) for _ in range(3)]]) for _ in range(rng.randint(0, 6))]
            rows.append((key, k, rng.choice([None, *["\n".join(x for p in parts for x in p)] * 9])))
    rows += [(99, 1, "a = 1\nb = 2\nc = 3")] * 3 + [(100, 1, ""), (101, 1, None), (102, None, "one = 1\ntwo = 2\nthree = 3"), (102, 1, "four = 4\nfive = 5\nsix = 6")]
    table = spark.createDataFrame(rows, "k int, o int, t string")
    stitched = spark.createDataFrame([(k, folds.stitch_revisions([r[2] or "" for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, r[1] or 0))])) for k in {r[0] for r in rows}], "k int, text string")
    ids = stitched.select(F.coalesce("k", F.lit(-1)).alias("id"), lines.clean_text(F.col("text")).alias("text"))
    texts = {r.id: folds.dedup_blocks(r.text) for r in ids.collect()}
    lined = lines.explode_lines(spark.createDataFrame(list(texts.items()), "id int, text string"))
    many = {r.id for r in lines.sections(lined).groupBy("id").count().filter("count > 1").collect()}
    kept = {}
    for r in sorted(lines.dedup_sections(lined).collect(), key=lambda r: (r.id, r.i)):
        kept.setdefault(r.id, []).append(r.line)
    want = {k: folds.dedup_passages("\n".join(kept[k]).rstrip("\n") if k in many else text) for k, text in texts.items()}
    plan = chain.text_chain(table, "k", "o", "t")
    assert {-1 if r.id is None else r.id: r.text for r in plan.collect()} == want and plan.count() == len(want) == 65
    assert len(many) > 20 and want[99] == "a = 1\nb = 2\nc = 3" and want[100] == want[101] == ""
    shown = plan._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in shown and "__row" in shown
