"""Fetching archives over HTTP: skipped if the manifest has them, throttled, retried, renamed when whole."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from ..config import Config

ARCHIVE_URL = "https://www.sec.gov/files/dera/data/financial-statement-data-sets/{quarter}.zip"


def manifest_path(config: Config) -> Path:
    return config.raw_dir / "manifest.json"


def read_manifest(config: Config) -> dict:
    path = manifest_path(config)
    return json.loads(path.read_text()) if path.exists() else {}


def write_manifest(config: Config, manifest: dict) -> None:
    part = manifest_path(config).with_suffix(".part")
    part.write_text(json.dumps(manifest, indent=1, sort_keys=True))
    part.rename(manifest_path(config))


def missing(config: Config, quarters: tuple[str, ...]) -> list[str]:
    """The quarters that the manifest doesn't hold, or whose file isn't as long as it says."""
    manifest = read_manifest(config)

    def held(q: str) -> bool:
        file = config.raw_dir / f"{q}.zip"
        return manifest.get(q, {}).get("status") == "ok" and file.exists() and file.stat().st_size == manifest[q]["bytes"]

    return [q for q in quarters if not held(q)]


class DownloadError(OSError):
    """An archive that didn't come in any of the tries."""


def fetch(url: str, config: Config) -> Iterator[bytes]:
    """The answer, some megabytes at a time."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": config.user_agent}), timeout=120) as response:
        while block := response.read(1 << 22):
            yield block


def received(blocks: Iterable[bytes], to: Path) -> dict:
    """Write the blocks, renamed once they are whole: bytes and sha256."""
    part, digest, n = to.with_name(to.name + ".part"), hashlib.sha256(), 0
    try:
        with open(part, "wb") as f:
            for block in blocks:
                f.write(block)
                digest.update(block)
                n += len(block)
        part.rename(to)
    finally:
        part.unlink(missing_ok=True)
    return {"bytes": n, "sha256": digest.hexdigest()}


def download(config: Config, quarters: tuple[str, ...] | None = None, get: Callable[[str, Config], Iterable[bytes]] = fetch, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Fetch what is missing; the manifest gets url, bytes, sha256, time and status of each quarter. Raises where all tries fail."""
    config.raw_dir.mkdir(parents=True, exist_ok=True)
    manifest = read_manifest(config)
    for quarter in missing(config, quarters or config.quarters):
        url = ARCHIVE_URL.format(quarter=quarter)
        manifest[quarter] = {"url": url, "status": "failed"}
        for attempt in range(config.max_retries):
            try:
                manifest[quarter] = {"url": url, **received(get(url, config), config.raw_dir / f"{quarter}.zip"), "fetched_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "status": "ok"}
                break
            except OSError as e:
                manifest[quarter]["error"] = str(e)
                if attempt + 1 < config.max_retries:
                    sleep(2**attempt)
        write_manifest(config, manifest)
        if manifest[quarter]["status"] != "ok":
            raise DownloadError(f"{quarter}: {manifest[quarter].get('error')}")
        sleep(config.rate_limit_sleep)
    return manifest
