"""``python -m scrollweave scrape VIDEO...`` reads code from screen recordings; ``refine FILE...`` mends texts."""

from __future__ import annotations

import argparse
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scrollweave.operators import backends, extract
from scrollweave.plans.chain import Settings, scrape
from scrollweave.sources import readers, sinks, video


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scrollweave", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("scrape", help="code of videos, into a folder for each")
    one.add_argument("videos", nargs="+", help="paths that every executor can open")
    one.add_argument("-o", "--output", default="output", help="a folder that every executor can write to")
    one.add_argument("--model", default="qwen2.5vl:7b", help="vision model of the service")
    one.add_argument("--ollama-host", default="http://localhost:11434", help="address of the service")
    one.add_argument("--ssim-threshold", type=float, default=0.95)
    one.add_argument("--ocr", action="store_true", help="read with the OCR program")
    one.add_argument("--gpu-ocr", action="store_true", help="read with ONNX models")
    one.add_argument("--model-dir", default=os.path.expanduser("~/.scrollweave/models"), help="folder of the ONNX models")
    one.add_argument("--parallel", type=int, default=4, help="images read at a time in a task")
    one.add_argument("--work-dir", help="a folder that every executor can read and write, for frames and texts on the way; spark.checkpoint.dir by default")
    one.add_argument("--decoder", default="ffmpeg", help="program that decodes videos")
    one.add_argument("--probe", default="ffprobe", help="program that tells their durations")
    one.add_argument("--refine", action="store_true", help="mend the final text by a model")
    mend = commands.add_parser("refine", help="mend text files, into x.refined.txt beside x.txt")
    mend.add_argument("files", nargs="+")
    for command in (one, mend):
        command.add_argument("--refine-url", default="https://api.anthropic.com/v1/messages")
        command.add_argument("--refine-model", default="claude-opus-4-20250514")
        command.add_argument("--refine-agents", type=int, default=4, help="chunks refined at a time")
    return top


def refiner(args: argparse.Namespace):
    key = os.environ.get("ANTHROPIC_API_KEY")
    if not key:
        raise SystemExit("ANTHROPIC_API_KEY is not set; refining needs it")
    return backends.messages_api(args.refine_url, key, args.refine_model)


def register(args: argparse.Namespace) -> str:
    """Put the backends that the arguments describe in the registry; the name of the one to use."""
    if args.gpu_ocr and (gone := backends.missing_models(args.model_dir)):
        raise SystemExit(f"{args.model_dir} lacks {', '.join(gone)}")
    if args.ocr and not args.gpu_ocr and not video.available("tesseract", "--version"):
        raise SystemExit("the OCR program is not installed")
    extract.BACKENDS |= {"onnx": backends.onnx(args.model_dir), "ocr": backends.tesseract(), "vlm": backends.generate_api(args.ollama_host, args.model)}
    return extract.choose({name for name, on in (("onnx", args.gpu_ocr), ("ocr", args.ocr), ("vlm", True)) if on})


def run_scrape(spark: SparkSession, args: argparse.Namespace) -> None:
    if gone := [v for v in args.videos if "://" not in v and not Path(v).exists()]:
        raise SystemExit(f"not found: {', '.join(gone)}")
    videos = spark.createDataFrame([(Path(v).stem, v) for v in args.videos], "video_id string, path string").repartition(len(args.videos))
    work = args.work_dir or spark.conf.get("spark.checkpoint.dir", None)
    settings = Settings(args.ssim_threshold, register(args), max(1, args.parallel), max(1, args.refine_agents), work, refiner(args) if args.refine else None)
    began = time.time()
    counted = extract.Progress("frames")
    images = counted.watch(video.sampled(videos, args.decoder))
    written = sinks.write_output(scrape(images, settings, video.durations(videos, args.probe)), args.output).collect()
    seconds = time.time() - began
    print(f"{counted.rows()} frames sampled, {len(written)} of {len(args.videos)} videos written in {seconds:.1f} s ({counted.rows() / max(seconds, 1e-9):.1f} frames a second)")
    for row in written:
        print(f"{row.video_id}: {row.path} ({', '.join(row.names)})")
    if not written:
        raise SystemExit("no frames were found")


def run_refine(spark: SparkSession, args: argparse.Namespace) -> None:
    client = refiner(args)
    texts = readers.text_file(spark, args.files)
    done = extract.refine(texts.select(F.col("path").alias("id"), "text"), client, args.refine_agents)
    for row in sinks.write_refined(done.withColumnRenamed("id", "path")).collect():
        print(f"written: {row.written}")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("scrollweave").getOrCreate()
    {"scrape": run_scrape, "refine": run_refine}[args.command](spark, args)


if __name__ == "__main__":
    main(sys.argv[1:])
