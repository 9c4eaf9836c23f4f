"""Table and region readers: a registry of backends, a client of a local vision server, and readers in a process of their own.

A backend is a picklable factory () -> function(crop, region, blocks, offset)
that gives table HTML or None; crop is PNG bytes.  None is bundled with a model:
factories import what they need in the worker, and fail into None.
"""

from __future__ import annotations

import base64
import json
import re
import subprocess
import sys
import tempfile
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from pagemill.operators import images

DEFAULT = "gridboost"
ALIASES = {"vision": "vision_local"}
FIRST_TABLE = re.compile(r"<table.*?</table>", re.IGNORECASE | re.DOTALL)
CROP_SIDE = 1400
TABLE_REQUEST = "Read the table in this picture. Answer with one HTML <table> and nothing else: a <tr> for each line, a <td> for each cell, empty cells too; copy numbers and signs as they stand."
REGION_REQUEST = "Copy the text of this picture as Markdown, tables as pipe tables. Keep the order, numbers and signs; add nothing and answer with the Markdown alone."


@dataclass(frozen=True)
class Server:
    """A vision or language server that answers JSON over HTTP."""

    endpoint: str = "http://localhost:11434"
    model: str = ""
    timeout: float = 180.0
    answer: int = 2048
    temperature: float = 0.0
    keep_alive: str | None = None

    def ask(self, prompt: str, picture: bytes | None = None) -> str | None:
        """The answer, or None where there is none for any reason."""
        body = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": self.temperature, "num_predict": self.answer}}
        if picture is not None:
            body["images"] = [base64.b64encode(picture).decode("ascii")]
        if self.keep_alive:
            body["keep_alive"] = self.keep_alive
        request = urllib.request.Request(self.endpoint.rstrip("/") + "/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return json.load(reply).get("response") or None
        except Exception:  # noqa: BLE001 a server may fail in any way
            return None


def corrector(server: Server = Server(timeout=10.0, answer=100, temperature=0.1)) -> Callable:
    """A language model for recognize.correct(): a text whose request fails stays as it is."""

    def make():
        def answer(prompts: list[str]) -> list[str]:
            kept = [p.rsplit("Text: ", 1)[-1].removesuffix("\nCorrected:") for p in prompts]
            return [(server.ask(p) or k).strip() or k for p, k in zip(prompts, kept, strict=True)]

        return answer

    return make


def first_table(reply: str | None) -> str | None:
    found = FIRST_TABLE.search((reply or "").replace("```html", "").replace("```", ""))
    return found.group() if found else None


def vision_tables(server: Server) -> Callable:
    return lambda: lambda crop, region, blocks, offset: first_table(server.ask(TABLE_REQUEST, crop))


def vision_regions(server: Server = Server(timeout=600.0, keep_alive="30m")) -> Callable:
    """A transcriber for flows.rebuild(): crops are made smaller so that their longest side is CROP_SIDE at most."""
    return lambda: lambda crop: server.ask(REGION_REQUEST, images.png(images.shrunk(images.from_png(crop), CROP_SIDE)))


def with_grid(reader: Callable) -> Callable:
    """reader on crops that are decoloured and ruled along the blocks' virtual grid; on the crop as it is where that fails."""

    def make():
        read = reader()

        def run(crop, region, blocks, offset):
            try:
                picture = images.gridded(images.from_png(crop), blocks, offset)
                crop = images.png(picture)
            except Exception:  # noqa: BLE001
                pass
            return read(crop, region, blocks, offset)

        return run

    return make


def isolated(command: list[str] | None = None, timeout: float = 900.0) -> Callable:
    """A backend in an interpreter of its own: called with a PNG's path, it prints a JSON object whose html is the table.

    Its prints before the last line are ignored; a failure, a missing table or
    the time limit give None.
    """
    command = command or [sys.executable, "-m", "pagemill_table_worker"]

    def make():
        def run(crop, region, blocks, offset):
            with tempfile.NamedTemporaryFile(suffix=".png") as f:
                f.write(crop)
                f.flush()
                try:
                    done = subprocess.run([*command, f.name], capture_output=True, timeout=timeout, check=True, text=True)
                    return first_table(json.loads(done.stdout.strip().splitlines()[-1]).get("html"))
                except Exception:  # noqa: BLE001
                    return None

        return run

    return make


class Registry:
    """Backends by name."""

    def __init__(self) -> None:
        self.made: dict[str, Callable] = {}

    def add(self, name: str, backend: Callable) -> Registry:
        self.made[name] = backend
        return self

    def choose(self, override: str | None = None, tier: str | None = None) -> tuple[str, Callable | None]:
        """(name, backend): the override, else the tier, else DEFAULT; unknown names are DEFAULT, and "manual" has no backend."""
        name = override or tier or DEFAULT
        if name == "manual":
            return name, None
        known = name if name in self.made else ALIASES.get(name, DEFAULT)
        return name, self.made.get(known, self.made.get(DEFAULT))


def standard(table_reader: Callable, server: Server | None = None, command: list[str] | None = None) -> Registry:
    """The four usual backends around a table reader: plain, on gridded crops, in its own interpreter, and a vision server."""
    return Registry().add("ppstructure", table_reader).add("gridboost", with_grid(table_reader)).add("ppstructurev3", isolated(command)).add("vision_local", vision_tables(server or Server()))


def blocks_box(blocks: list[dict]) -> np.ndarray:
    """x0, y0, x1, y1 of blocks with bbox points."""
    return np.array([[min(p["x"] for p in b["bbox"]), min(p["y"] for p in b["bbox"]), max(p["x"] for p in b["bbox"]), max(p["y"] for p in b["bbox"])] for b in blocks if b.get("bbox")]).reshape(-1, 4)
