"""Backends that read an image: an OCR program, a model service over HTTP, and two ONNX models.

A backend makes, in a task, one function from the bytes of a PNG and a prompt to text; see ``extract``. Nothing here is
loaded until a task calls it.
"""

from __future__ import annotations

import base64
import json
import os
import subprocess
import tempfile
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np

from scrollweave.operators.folds import trim
from scrollweave.operators.frames import read_png, resize

Reader = Callable[[bytes, str], str]


class Unavailable(ConnectionError):
    """The service can't answer now; asking again may help."""


def post(url: str, payload: dict, headers: dict[str, str], timeout: float, retry_on: Callable[[int], bool]) -> dict:
    """The JSON answer to a JSON request. A status that ``retry_on`` takes raises Unavailable, another one over 399
    ValueError."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"content-type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        body = e.read().decode(errors="replace")[:500]
        if retry_on(e.code):
            raise Unavailable(f"{url} answered {e.code}: {body}") from e
        raise ValueError(f"{url} answered {e.code}: {body}") from e


def tesseract(command: str = "tesseract") -> Callable[[], Reader]:
    """A program that takes an image's path and prints its text."""

    def make() -> Reader:
        def read(image: bytes, prompt: str) -> str:
            with tempfile.TemporaryDirectory() as folder:
                path = Path(folder, "frame.png")
                path.write_bytes(image)
                done = subprocess.run([command, str(path), "stdout", "--psm", "6", "-c", "preserve_interword_spaces=1"], capture_output=True, check=False)
            if done.returncode:
                raise RuntimeError(f"{command} failed: {done.stderr.decode(errors='replace')}")
            return done.stdout.decode(errors="replace")

        return read

    return make


def generate_api(host: str, model: str, timeout: float = 60.0) -> Callable[[], Reader]:
    """A vision model behind ``host/api/generate``. Transport errors and statuses over 499 are worth another try."""

    def make() -> Reader:
        def read(image: bytes, prompt: str) -> str:
            options = {"temperature": 0.1, "num_predict": 4096, "num_ctx": 8192}
            payload = {"model": model, "prompt": prompt, "images": [base64.b64encode(image).decode()], "stream": False, "options": options}
            try:
                return post(f"{host}/api/generate", payload, {}, timeout, lambda status: status >= 500)["response"]
            except (urllib.error.URLError, TimeoutError) as e:
                raise Unavailable(str(e)) from e

        return read

    return make


#: Fixed values of the ONNX models: colour means and deviations, sizes and thresholds.
MEAN, DEVIATION = np.array([0.485, 0.456, 0.406], np.float32), np.array([0.229, 0.224, 0.225], np.float32)
LONGEST, STEP, ROW, LEAST_WIDTH, INK, DENSE = 960, 32, 48, 320, 0.3, 0.02
MODEL_FILES = ("det.onnx", "rec.onnx", "dict.txt")


def missing_models(folder: str | os.PathLike) -> list[str]:
    """The files of MODEL_FILES that ``folder`` lacks."""
    return [name for name in MODEL_FILES if not Path(folder, name).exists()]


def dictionary(path: str | os.PathLike) -> list[str]:
    """One entry a line."""
    text = Path(path).read_text(encoding="utf-8").replace("\r\n", "\n")
    return text.removesuffix("\n").split("\n") if text else []


def line_height(h: int) -> int:
    return int(max(h / 1080.0 * 25.0, 12.0))


def detection_size(w: int, h: int) -> tuple[int, int]:
    """The size for the detection model: no side over LONGEST, each a multiple of STEP, never enlarged but for that."""
    scale = min(1.0, LONGEST / max(w, h))
    up = lambda n: -(-max(int(n * scale), STEP) // STEP) * STEP
    return up(w), up(h)


def detection_input(rgb: np.ndarray) -> np.ndarray:
    w, h = detection_size(rgb.shape[1], rgb.shape[0])
    small = np.stack([resize(rgb[..., c], w, h) for c in range(3)], -1).astype(np.float32) / 255
    return ((small - MEAN) / DEVIATION).transpose(2, 0, 1)[None].astype(np.float32)


def recognition_input(line: np.ndarray) -> np.ndarray:
    """Of a line ROW high, padded with zeros to LEAST_WIDTH."""
    h, w, _ = line.shape
    wide = int(max(w / h * ROW, 1.0))
    out = np.zeros((1, 3, ROW, max(wide, LEAST_WIDTH)), np.float32)
    for c in range(3):
        out[0, c, :, :wide] = resize(line[..., c], wide, ROW).astype(np.float32) / 127.5 - 1
    return out


def slices(h: int) -> list[tuple[int, int]]:
    """Line heights from the top, and what is left over if that is more than half of one."""
    tall = line_height(h)
    out = [(y, y + tall) for y in range(0, h - tall + 1, tall)]
    end = out[-1][1] if out else 0
    return [*out, (end, h)] if h - end > tall // 2 else out


def bands(ink: np.ndarray, h: int) -> list[tuple[int, int]]:
    """The text lines of a frame ``h`` high by the detection model's map: runs of rows with enough ink, tall runs cut into
    lines; even slices where there is none."""
    dense = np.concatenate([[False], (ink > INK).mean(1) > DENSE, [False]])
    edges = np.flatnonzero(dense[1:] != dense[:-1])
    scale, tall, out = h / ink.shape[0], line_height(h), []
    for y0, y1 in zip((edges[::2] * scale).astype(int).tolist(), (edges[1::2] * scale).astype(int).tolist(), strict=True):
        n = 1 if y1 - y0 <= int(tall * 1.8) else max(2, int(np.floor((y1 - y0) / tall + 0.5)))
        step = (y1 - y0) // n
        out += [(y0 + k * step, y1 if k == n - 1 else y0 + (k + 1) * step) for k in range(n)]
    return out or slices(h)


def ctc(scores: np.ndarray, entries: Sequence[str]) -> str:
    """Text of the best class at each step (the first of equals); see ``frames.ctc_decode`` for the rules."""
    best = scores.argmax(1)
    told = np.flatnonzero(best)
    gaps = np.diff(told) - 1
    inner = np.sort(gaps[gaps > 0])
    wide = max(int(inner[len(inner) // 2] * 2.5), 4) if len(inner) > 2 else 8
    out: list[str] = []
    for k, at in enumerate(told):
        run = at - told[k - 1] - 1 if k else at
        if run >= wide and out:
            out.append(" ")
        if (at == 0 or best[at] != best[at - 1]) and best[at] <= len(entries):
            out.append(entries[best[at] - 1])
    return "".join(out)


def onnx(folder: str, session: Callable[[str], Callable[[np.ndarray], np.ndarray]] | None = None) -> Callable[[], Reader]:
    """A detection and a recognition model and their dictionary in ``folder``, loaded once a task. ``session`` opens a
    model; the runtime's by default."""

    def opened(path: str) -> Callable[[np.ndarray], np.ndarray]:
        import onnxruntime

        model = onnxruntime.InferenceSession(path)
        name = model.get_inputs()[0].name
        return lambda x: model.run(None, {name: x})[0]

    def make() -> Reader:
        if gone := missing_models(folder):
            raise FileNotFoundError(f"{folder} lacks {', '.join(gone)}")
        detect, recognise = ((session or opened)(str(Path(folder, name))) for name in MODEL_FILES[:2])
        entries = dictionary(Path(folder, MODEL_FILES[2]))

        def read(image: bytes, prompt: str) -> str:
            pixels = read_png(image)
            ink = detect(detection_input(pixels))
            if ink.ndim != 4:
                raise ValueError(f"the detection model's output has {ink.ndim} dimensions, not 4")
            out = []
            for y0, y1 in bands(ink[0, 0], pixels.shape[0]):
                y0, y1 = min(y0, pixels.shape[0] - 1), min(y1, pixels.shape[0])
                if y1 - y0 < 3:
                    continue
                try:
                    text = trim(ctc(recognise(recognition_input(pixels[y0:y1]))[0], entries))
                except Exception:  # a line that can't be read is left out
                    continue
                if text:
                    out.append(text)
            return "\n".join(out)

        return read

    return make


#: What the model is told to mend in a chunk of captured text.
REFINE = """The text below was read from the frames of a screen recording and put together by a program. Some damage is left. Mend it:

- Take out marks of diffs (lines that start with @@, --- or +++, or "diff --git"); where a line stands once with - and once with +, keep it once, without the mark.
- Where lines repeat one another exactly or nearly, keep the better one.
- Repair misread words and take out gibberish.
- Where something repeats three times or more inside a line, keep it once.
- Take out a section that stands here twice.
- Repair structure: headings without a body, broken markup, stray fences.
- Keep everything else.

Answer with the mended text alone: no remarks, and no fence around it."""


def messages_api(url: str, key: str, model: str, timeout: float = 600.0, most: int = 32_768) -> Callable[[], Callable[[str, int, int], str]]:
    """A client for ``refine``: chunk, its number and how many there are, to mended text. Statuses 429 and over 499 are worth
    another try; an answer that was cut off or refused is an error."""

    def make() -> Callable[[str, int, int], str]:
        def ask(chunk: str, number: int, of: int) -> str:
            said = [{"role": "user", "content": f"Part {number} of {of}:\n\n{chunk}"}]
            headers = {"x-api-key": key, "anthropic-version": "2023-06-01"}
            answer = post(url, {"model": model, "max_tokens": most, "system": REFINE, "messages": said}, headers, timeout, lambda s: s == 429 or s >= 500)
            if (why := answer.get("stop_reason")) in ("max_tokens", "refusal"):
                raise ValueError(f"part {number} of {of}: the answer ended by {why}")
            return "".join(block.get("text", "") for block in answer["content"])

        return ask

    return make
