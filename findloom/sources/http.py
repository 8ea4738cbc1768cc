"""Fetching over HTTP with retries and a conditional cache on disk.

For filling the folders that ``crawl`` reads, on a machine with a network; no query needs it.
"""

from __future__ import annotations

import hashlib
import json
import os
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from findloom.errors import EngineIOError

#: Attempts, first wait, and the longest wait, which is also the least after a server error, in seconds.
ATTEMPTS, FIRST_WAIT, LONG_WAIT, TIMEOUT = 20, 0.05, 5.0, 30.0
#: Bytes that a brotli body may unpack to.
MOST_UNPACKED = 64 << 20


@dataclass
class Response:
    status: int
    body: bytes
    headers: dict[str, str]


def get(url: str, headers: dict[str, str]) -> Response:
    request = urllib.request.Request(url, headers=headers)
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            return Response(answer.status, answer.read(), {k.lower(): v for k, v in answer.headers.items()})
    except urllib.error.HTTPError as error:
        return Response(error.code, b"", {})


class Fetcher:
    """``fetch`` gives a URL's body, empty for 404. Transport and sleep can be given."""

    def __init__(self, folder: str, transport: Callable[[str, dict[str, str]], Response] = get, sleep: Callable[[float], None] = time.sleep) -> None:
        self.folder, self.transport, self.sleep = folder, transport, sleep

    def _base(self, url: str) -> str:
        return os.path.join(self.folder, hashlib.sha256(url.encode()).hexdigest())

    def _held(self, url: str) -> tuple[bytes, dict[str, str]]:
        """Body and headers to ask with; nothing where the copy is missing, of another URL or damaged."""
        try:
            with open(self._base(url) + ".json") as file:
                about = json.load(file)
            with open(self._base(url) + ".body", "rb") as file:
                body = file.read()
        except (OSError, ValueError):
            return b"", {}
        if about.get("url") != url or about.get("sha256") != hashlib.sha256(body).hexdigest():
            return b"", {}
        asked = {"If-None-Match": about.get("etag"), "If-Modified-Since": about.get("modified")}
        return body, {k: v for k, v in asked.items() if v}

    def _hold(self, url: str, body: bytes, headers: dict[str, str]) -> None:
        etag, modified = headers.get("etag", ""), headers.get("last-modified", "")
        if not etag and not modified:
            return
        os.makedirs(self.folder, exist_ok=True)
        about = json.dumps({"url": url, "etag": etag, "modified": modified, "sha256": hashlib.sha256(body).hexdigest()})
        for suffix, data in ((".body", body), (".json", about.encode())):
            with open(self._base(url) + suffix + ".tmp", "wb") as file:
                file.write(data)
            os.replace(self._base(url) + suffix + ".tmp", self._base(url) + suffix)

    def fetch(self, url: str) -> bytes:
        held, asked = self._held(url)
        wait = FIRST_WAIT
        for attempt in range(ATTEMPTS):
            floor = 0.0
            try:
                answer = self.transport(url, asked)
            except OSError as error:
                if attempt == ATTEMPTS - 1:
                    raise EngineIOError(f"{url}: {error}") from error
            else:
                if 200 <= answer.status < 300:
                    body = unpacked(answer)
                    self._hold(url, body, answer.headers)
                    return body
                if answer.status == 304 and held:
                    return held
                if answer.status == 404:
                    return b""
                if 400 <= answer.status < 500 or attempt == ATTEMPTS - 1:
                    raise EngineIOError(f"HTTP {answer.status} for {url}")
                floor = LONG_WAIT if answer.status >= 500 else 0.0
            self.sleep(max(wait + random.uniform(0, wait / 4), floor))
            wait = min(2 * wait, LONG_WAIT)
        return b""


def unpacked(answer: Response) -> bytes:
    if answer.headers.get("content-encoding", "").lower() != "br":
        return answer.body
    try:
        import brotli
    except ImportError as error:
        raise EngineIOError("a brotli body, and no brotli module") from error
    body = brotli.decompress(answer.body)
    if len(body) > MOST_UNPACKED:
        raise EngineIOError("brotli body is too large")
    return body
