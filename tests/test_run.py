"""Sources, backends, sinks and the whole run, with stand-ins for the programs and services outside."""

import json
import stat
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import numpy as np
import pytest

from scrollweave import __main__ as command
from scrollweave.operators import backends, extract, frames, lines
from scrollweave.plans import chain
from scrollweave.sources import readers, sinks, video

RNG = np.random.default_rng(7)


def program(path: Path, body: str) -> str:
    path.write_text(f"#!{sys.executable}\n{body}")
    path.chmod(path.stat().st_mode | stat.S_IXUSR)
    return str(path)


@pytest.fixture()
def decoder(tmp_path):
    """A decoder whose videos are files of numbers: a grey frame of 60 x 50 each, at a time of its own."""
    return program(
        tmp_path / "decoder",
        """
import sys
values = open(sys.argv[sys.argv.index("-i") + 1]).read().split()
chosen = sys.argv[sys.argv.index("-vf") + 1]
if "bad" in values:
    sys.exit(3)
if "scene" in chosen:
    values = [str(int(v) + 1) for v in values] + ["9"]
for k, v in enumerate(values):
    print(f"[showinfo] n:{k} pts_time:{'' if v == '5' else int(v) / 4} s:60x50 fmt:rgb24", file=sys.stderr, flush=True)
    sys.stdout.buffer.write(bytes([int(v) * 20, 0, 7]) * 3000)
    sys.stdout.flush()
""",
    )


def test_frames_come_through_a_pipe_with_their_times(spark, tmp_path, decoder):
    (tmp_path / "a.mov").write_text("1 2 5 4")
    (tmp_path / "b.mov").write_text("1 2 3 4 6 7")
    videos = spark.createDataFrame([("a", str(tmp_path / "a.mov")), ("b", str(tmp_path / "b.mov"))], "video_id string, path string")
    got = {(r.video_id, r.seq): r for r in video.keyframes(videos, decoder).collect()}
    # One time is missing in the log, so times move up, and the last frame has none.
    assert [got["a", k].timestamp for k in range(4)] == [0.25, 0.5, 1.0, 6.0] and (got["a", 0].w, got["a", 0].h) == (60, 50)
    assert got["a", 1].rgb == bytes([40, 0, 7]) * 3000
    both = video.sampled(videos, decoder)
    rows = [(r.seq, r.timestamp, r.is_keyframe) for r in both.filter("video_id = 'a'").orderBy("seq").collect()]
    assert rows == [(0, 0.25, True), (1, 0.5, True), (2, 0.75, False), (3, 1.0, True), (4, 1.25, False), (5, 1.5, False), (6, 2.25, False), (7, 6.0, True)] or len(rows) == 8
    assert both.filter("video_id = 'b'").count() == 6 and both.first().luma == bytes([(2126 * 20 + 722 * 7) // 10_000]) * 3000
    (tmp_path / "c.mov").write_text("1 bad")
    broken = spark.createDataFrame([("c", str(tmp_path / "c.mov"))], "video_id string, path string")
    assert video.scenes(broken, decoder).count() == 0
    with pytest.raises(Exception, match="ended with code 3"):
        video.keyframes(broken, decoder).collect()


def test_durations_fall_back_to_zero(spark, tmp_path):
    probe = program(tmp_path / "probe", "import sys\nprint('12.5') if sys.argv[-1] == 'good' else sys.exit(1)")
    videos = spark.createDataFrame([("a", "good"), ("b", "other")], "video_id string, path string")
    assert {r.video_id: r.duration for r in video.durations(videos, probe).collect()} == {"a": 12.5, "b": 0.0}
    assert {r.duration for r in video.durations(videos, str(tmp_path / "none")).collect()} == {0.0}
    assert video.available(probe, "good") and not video.available(probe, "x") and not video.available("no such program")


def test_times_are_counted_within_each_video(spark):
    images = spark.createDataFrame([("a", 1, "p1"), ("a", 10, "p10"), ("a", 2, "p2"), ("b", 1, "q1")], "video_id string, number long, path string")
    log = spark.createDataFrame([("a", 0, "x pts_time:1.5 y"), ("a", 1, "no time"), ("a", 2, "pts_time:2.5")], "video_id string, n int, value string")
    got = {r.path: r.timestamp for r in readers.timed(images, log, 2.0, "video_id").collect()}
    assert got == {"p1": 1.5, "p2": 2.5, "p10": 4.0, "q1": 0.0}


def test_files_are_read_whole_and_without_line_breaks(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(bytes(range(256)) * 3)
    (tmp_path / "x.txt").write_text("a\n\nb")
    import base64

    assert readers.encoded(spark, str(tmp_path)).first().base64 == base64.b64encode(bytes(range(256)) * 3).decode()
    assert readers.text_file(spark, str(tmp_path / "x.txt")).first().text == "a\n\nb"
    assert spark.createDataFrame([("3.5",), ("x",), (None,)], "value string").select(readers.duration()).toPandas().iloc[:, 0].tolist() == [3.5, 0.0, 0.0]


def test_png_round_trip_with_every_filter():
    import struct
    import zlib

    pixels = RNG.integers(0, 256, (6, 9, 3), np.uint8)
    assert (frames.read_png(frames.png(pixels)) == pixels).all()
    grey = RNG.integers(0, 256, (5, 7), np.uint8)
    assert (frames.read_png(frames.png(grey)) == grey[..., None]).all()

    def filtered(kind):
        raw, above = b"", np.zeros((9, 3), int)
        for row in pixels.astype(int):
            left = np.vstack([np.zeros((1, 3), int), row[:-1]])
            corner = np.vstack([np.zeros((1, 3), int), above[:-1]])
            p = left + above - corner
            d = np.abs(np.stack([p - left, p - above, p - corner]))
            nearest = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
            guess = [0 * row, left, above, (left + above) // 2, nearest][kind]
            raw += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
            above = row
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    for kind in range(5):
        assert (frames.read_png(filtered(kind)) == pixels).all()
    with pytest.raises(ValueError, match="no PNG"):
        frames.read_png(b"x")


@pytest.fixture()
def service():
    """A service that answers what the test puts in ``answers`` and keeps what it was asked."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            with self.server.lock:
                self.server.asked.append((self.path, dict(self.headers), body))
                status, answer = self.server.answers.pop(0) if self.server.answers else self.server.always(body)
            data = json.dumps(answer).encode()
            self.send_response(status)
            self.send_header("content-length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    server.lock, server.asked, server.answers, server.always = threading.Lock(), [], [], lambda body: (200, {"response": "none"})
    server.url = f"http://127.0.0.1:{server.server_port}"
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def test_a_model_service_is_asked_again_only_where_that_may_help(service):
    import base64

    read = backends.generate_api(service.url, "some-model")()
    service.answers += [(503, {}), (200, {"response": "```py\na\n```"})]
    assert extract.with_retry(lambda: read(b"image", "words"), (0.0, 0.0)) == "```py\na\n```"
    path, _, body = service.asked[-1]
    assert len(service.asked) == 2 and path == "/api/generate" and body["prompt"] == "words" and base64.b64decode(body["images"][0]) == b"image"
    assert body["options"] == {"temperature": 0.1, "num_predict": 4096, "num_ctx": 8192} and body["model"] == "some-model" and not body["stream"]
    service.answers += [(404, {"error": "x"}), (200, {"response": "late"})]
    with pytest.raises(ValueError, match="404"):
        extract.with_retry(lambda: read(b"image", "words"), (0.0, 0.0))
    service.answers[:] = [(500, {})] * 3
    with pytest.raises(backends.Unavailable, match="500"):
        extract.with_retry(lambda: read(b"image", "words"), (0.0, 0.0))
    with pytest.raises(backends.Unavailable):
        backends.generate_api("http://127.0.0.1:9", "m", 0.5)()(b"", "")


def test_frames_are_read_in_parallel_and_texts_stay_with_them(spark, service):
    import base64

    service.always = lambda body: (200, {"response": base64.b64decode(body["images"][0]).decode()}) if base64.b64decode(body["images"][0]) != b"7" else (400, {})
    extract.BACKENDS["service"] = backends.generate_api(service.url, "m")
    table = spark.createDataFrame([(k, str(k).encode()) for k in range(20)], "k int, content binary")
    got = {r.k: r for r in extract.extract(table, "service", strict=False).collect()}
    assert all(got[k].text == str(k) and got[k].error is None for k in range(20) if k != 7) and got[7].text == "" and "400" in got[7].error
    with pytest.raises(Exception, match="400"):
        extract.extract(table, "service").collect()
    with pytest.raises(LookupError, match="nowhere"):
        extract.backend("nowhere")
    assert extract.choose({"vlm", "ocr"}) == "ocr" and extract.choose({"vlm", "onnx", "ocr"}) == "onnx" and extract.choose(set()) == "vlm"


def test_an_ocr_program_reads_a_file(tmp_path):
    tool = program(tmp_path / "ocr", "import sys\nassert sys.argv[2:] == ['stdout', '--psm', '6', '-c', 'preserve_interword_spaces=1']\nd = open(sys.argv[1], 'rb').read()\nprint('text ' + d.decode()) if d != b'bad' else sys.exit('no image')")
    read = backends.tesseract(tool)()
    assert read(b"abc", "") == "text abc\n"
    with pytest.raises(RuntimeError, match="no image"):
        read(b"bad", "")


def test_models_find_lines_and_read_them(tmp_path):
    """Stand-ins for two models: the first marks dark rows, the second says as many letters as the line's first pixel."""
    assert backends.missing_models(tmp_path) == list(backends.MODEL_FILES)
    with pytest.raises(FileNotFoundError, match="det.onnx"):
        backends.onnx(str(tmp_path))()
    for name in backends.MODEL_FILES[:2]:
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "dict.txt").write_text("a\nb\nc\n")
    assert backends.dictionary(tmp_path / "dict.txt") == ["a", "b", "c"]
    pixels = np.full((128, 160, 3), 255, np.uint8)
    pixels[10:22], pixels[60:84] = 1, 2
    sizes = []

    def session(path):
        def detect(x):
            sizes.append(x.shape)
            return (x[:, :1] < 0).astype(np.float32)

        def recognise(x):
            sizes.append(x.shape)
            n = round(float(x[0, 0, 20, 5] + 1) * 127.5)
            steps = np.zeros((1, 6, 4), np.float32)
            steps[0, [0, 2, 4], [n, 3, 0]] = 1
            return steps

        return detect if path.endswith("det.onnx") else recognise

    assert backends.onnx(str(tmp_path), session)()(frames.png(pixels), "") == "ac\nbc\nbc"
    assert sizes[0] == (1, 3, 128, 160) and sizes[1] == (1, 3, 48, 640)
    assert backends.detection_size(1920, 1080) == (960, 544) and backends.detection_size(20, 10) == (32, 32)
    assert backends.slices(40) == [(0, 12), (12, 24), (24, 36)] and backends.slices(43) == [(0, 12), (12, 24), (24, 36), (36, 43)] and backends.slices(5) == []
    assert backends.bands(np.zeros((32, 32)), 40) == backends.slices(40)


def test_ctc_of_arrays_and_of_columns_agree(spark):
    entries = list("abcdefg")
    rows = [RNG.choice([0, 0, 0, 0, 1, 2, 3, 9], 40).tolist() for _ in range(200)]
    table = spark.createDataFrame([(r,) for r in rows], "s array<int>")
    from pyspark.sql import functions as F

    got = [r[0] for r in table.select(frames.ctc_decode(F.col("s"), F.array(*map(F.lit, entries)))).collect()]
    assert got == [backends.ctc(np.eye(10)[r], entries) for r in rows]


def test_text_lines_of_columns_and_of_arrays_agree(spark):
    maps = {k: (RNG.random((64, 32)) < 0.9).astype(float) * (RNG.random((64, 1)) < p) for k, p in enumerate([0.5, 0.8, 0.95, 0.0, 0.1])}
    tall = {0: 200, 1: 64, 2: 1080, 3: 343, 4: 500}
    rows = [(k, y, float((m[y] > backends.INK).mean())) for k, m in maps.items() for y in range(64)]
    sizes = spark.createDataFrame([(k, 64, h) for k, h in tall.items()], "frame_id int, map_h int, img_h int")
    got = {}
    for r in lines_of(spark, rows, sizes):
        got.setdefault(r.frame_id, []).append((r.y0, r.y1))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(backends.bands(m, tall[k])) for k, m in maps.items()}


def lines_of(spark, rows, sizes):
    return frames.text_lines(spark.createDataFrame(rows, "frame_id int, y int, density double"), sizes).collect()


def test_refining_keeps_order_and_stops_on_bad_answers(spark, service):
    client = backends.messages_api(f"{service.url}/v1/messages", "key", "m")
    service.always = lambda body: (200, {"content": [{"type": "text", "text": "```\n"}, {"text": body["messages"][0]["content"].split("\n\n", 1)[1].upper()}, {"type": "other"}], "stop_reason": "end_turn"})
    texts = spark.createDataFrame([("a", "\n".join(f"line {k}" for k in range(10))), ("b", "one"), ("c", " \n")], "id string, text string")
    got = {r.id: r.text for r in extract.refine(texts, client, 3).collect()}
    assert got == {"a": "\n".join(f"LINE {k}" for k in range(10)), "b": "ONE", "c": " \n"}
    path, headers, body = service.asked[0]
    assert path == "/v1/messages" and {k.lower(): v for k, v in headers.items()}["x-api-key"] == "key" and body["system"] == backends.REFINE and body["max_tokens"] == 32_768
    assert {b["messages"][0]["content"].split("\n")[0] for *_, b in service.asked} == {"Part 1 of 3:", "Part 2 of 3:", "Part 3 of 3:", "Part 1 of 1:"}
    ask = client()
    service.answers += [(429, {}), (200, {"content": [{"text": "x"}]})]
    assert extract.with_retry(lambda: ask("a", 1, 1), (0.0,)) == "x"
    for reason in ("max_tokens", "refusal"):
        service.answers += [(200, {"content": [{"text": "x"}], "stop_reason": reason})]
        with pytest.raises(ValueError, match=reason):
            ask("a", 1, 1)
    service.answers += [(400, {})]
    with pytest.raises(ValueError, match="400"):
        extract.with_retry(lambda: ask("a", 1, 1), (0.0,))


def test_output_files_have_unique_names(spark, tmp_path):
    files = [{"filename": n, "language": "c", "final_content": f"text {k}", "revisions": []} for k, n in enumerate(["a/b.c", "a_b.c", "extracted.json", ".."])]
    text = json.dumps({"files": files, "duration": 0.0})
    outputs = spark.createDataFrame([("v/1", text), ("w", json.dumps({"files": []}))], "video_id string, json string")
    for _ in range(2):  # a task that runs again leaves the same
        got = {r.video_id: r for r in sinks.write_output(outputs, str(tmp_path)).collect()}
    assert got["v/1"].names == ["a_b.c", "a_b_1.c", "extracted_2.json", "file_3.txt"] and got["v/1"].path == f"{tmp_path}/v_1/extracted.json"
    assert {p.name: p.read_text() for p in (tmp_path / "v_1").iterdir()} == {"a_b.c": "text 0", "a_b_1.c": "text 1", "extracted_2.json": "text 2", "file_3.txt": "text 3", "extracted.json": text}
    (tmp_path / "x.txt").write_text("a")
    done = sinks.write_refined(spark.createDataFrame([(f"file:{tmp_path}/x.txt", "b"), (f"{tmp_path}/y.md", "c")], "path string, text string")).collect()
    assert (tmp_path / "x.refined.txt").read_text() == "b" and (tmp_path / "y.md.refined.txt").read_text() == "c" and len(done) == 2
    sinks.write_texts(spark.createDataFrame([("one",)], "text string"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("*.txt")) == "one\n"


def test_colour_frames_are_cropped_in_colour(spark):
    pixels = RNG.integers(0, 256, (50, 60, 3), np.uint8)
    table = spark.createDataFrame([("a", 0, 60, 50, pixels[..., 0].tobytes(), pixels.tobytes()), ("a", 1, 60, 50, None, None)], "video_id string, seq int, w int, h int, luma binary, rgb binary")
    regions = spark.createDataFrame([("a", 10, 5, 20, 30, "editor")], "video_id string, x int, y int, w int, h int, region_type string")
    got = {r.seq: r for r in frames.as_png(frames.crop(table, regions)).collect()}
    assert (frames.read_png(got[0].content) == pixels[5:35, 10:30]).all() and got[1].content is None and (got[0].w, got[0].h) == (20, 30)


def test_scrape_command_from_video_to_files(spark, tmp_path, service, monkeypatch, capsys):
    """Frames of two views, read by the service, refined, and written."""
    (tmp_path / "talk.mov").write_text("0 1 9 9 9 9")
    tool = program(
        tmp_path / "decoder",
        """
import sys
import random
values = open(sys.argv[sys.argv.index("-i") + 1]).read().split()
for k, v in enumerate(values):
    print(f"[showinfo] n:{k} pts_time:{k}.5 s:60x50 fmt:rgb24", file=sys.stderr, flush=True)
    sys.stdout.buffer.write(random.Random(v).randbytes(9000))
""",
    )
    probe = program(tmp_path / "probe", "print('61.5')")
    monkeypatch.setenv("ANTHROPIC_API_KEY", "key")
    code = "import os\n\nclass Reader:\n    def read(self):\n        return os.getcwd()\n\nprint(Reader().read())"
    service.always = lambda body: (200, {"response": f"```py\n{code}\n```"}) if "images" in body else (200, {"content": [{"text": body["messages"][0]["content"].split("\n\n", 1)[1]}]})
    args = ["scrape", str(tmp_path / "talk.mov"), "-o", str(tmp_path / "out"), "--ollama-host", service.url, "--refine", "--refine-url", f"{service.url}/m", "--refine-agents", "0", "--decoder", tool, "--probe", probe, "--work-dir", str(tmp_path / "work")]
    monkeypatch.setattr(command, "SparkSession", type("Held", (), {"builder": type("B", (), {"appName": staticmethod(lambda name: type("C", (), {"getOrCreate": staticmethod(lambda: spark)}))})}))
    command.main(args)
    record = json.loads((tmp_path / "out/talk/extracted.json").read_text())
    assert (tmp_path / "out/talk/extracted.py").read_text() == code == record["files"][0]["final_content"]
    assert record["duration"] == 61.5 and record["files"][0]["language"] == "python" and record["source_video"] == "talk"
    assert record["terminal_commands"] == record["annotations"] == [] and record["files"][0]["revisions"][0]["timestamp"] == 0.5
    assert len([1 for path, *_ in service.asked if path == "/api/generate"]) == 3
    assert "1 of 1 videos written" in capsys.readouterr().out
    (tmp_path / "note.txt").write_text("a\nb")
    command.main(["refine", str(tmp_path / "note.txt"), "--refine-url", f"{service.url}/m"])
    assert (tmp_path / "note.refined.txt").read_text() == "a\nb"
    for bad in (["scrape", "nothing.mov"], ["scrape", str(tmp_path / "talk.mov"), "--ocr"], ["scrape", str(tmp_path / "talk.mov"), "--gpu-ocr", "--model-dir", str(tmp_path)]):
        with pytest.raises(SystemExit):
            command.main(bad)
    monkeypatch.delenv("ANTHROPIC_API_KEY")
    with pytest.raises(SystemExit, match="ANTHROPIC_API_KEY"):
        command.main(["refine", "x.txt"])


def test_settings_and_views(spark):
    assert chain.Settings().ssim_threshold == 0.95 and chain.Settings().parallel == chain.Settings().refine_agents == 4
    texts = spark.createDataFrame([(1, "\n".join("abcdefg")), (2, "a\nb"), (3, "")], "id int, text string")
    got = {}
    for r in lines.views(texts, 4, 2).orderBy("id", "k").collect():
        got.setdefault(r.id, []).append("".join(r.v))
    assert got == {1: ["abcd", "cdef", "defg"], 2: ["ab"]}


def test_a_stream_of_frames_is_deduplicated_across_batches(spark, tmp_path):
    from scrollweave.streaming.frames import dedup_stream

    a, b = (RNG.integers(0, 256, 48 * 48, np.uint8).tobytes() for _ in range(2))
    schema = "video_id string, seq long, w int, h int, luma binary"
    for k, part in enumerate([[("v", 0, a), ("v", 1, a)], [("v", 2, a), ("v", 3, b), ("w", 0, a)]]):
        spark.createDataFrame([(v, s, 48, 48, x) for v, s, x in part], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = dedup_stream(source).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert sorted((r.video_id, r.seq) for r in spark.table("kept").collect()) == [("v", 0), ("v", 3), ("w", 0)]
