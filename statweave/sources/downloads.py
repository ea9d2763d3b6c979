"""PDF downloads into a folder that all executors share, each with a sidecar that says where it came from."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.error
import urllib.request

from pyspark.sql import DataFrame

from .connector import is_pdf

CHUNK = 1 << 16
#: Bytes in which a PDF must name itself.
HEAD = 1024
STATUS = "id string, url string, path string, bytes long, sha256 string, status string"


def fetch_pdf(url: str, path: str, most: int, opener=urllib.request.urlopen, timeout: float = 60) -> dict:
    """One file: read in chunks under a size bound into a part file of this attempt, renamed when whole; then its sidecar.

    The same file is written again by a task that is tried again, under the same name. What is too large, no PDF or
    unreachable leaves no file, and the status says why.
    """
    part = f"{path}.{os.getpid()}.part"
    digest, size, head, status = hashlib.sha256(), 0, b"", "ok"
    try:
        with opener(url, timeout=timeout) as reply, open(part, "wb") as out:
            announced = reply.headers.get("Content-Length") or ""
            kind = reply.headers.get("Content-Type") or ""
            if announced.isdigit() and int(announced) > most:
                status = "too large"
            while status == "ok" and (block := reply.read(CHUNK)):
                size += len(block)
                head += block[: HEAD - len(head)]
                digest.update(block)
                out.write(block)
                if size > most:
                    status = "too large"
        if status == "ok" and not is_pdf(head):
            status = "not a PDF"
        if status == "ok":
            with open(f"{part}.json", "w", encoding="utf-8") as side:
                json.dump({"url": url, "bytes": size, "sha256": digest.hexdigest(), "content_type": kind}, side)
            os.replace(f"{part}.json", f"{path}.json")
            os.replace(part, path)
    except (OSError, urllib.error.URLError) as error:
        status = f"failed: {error}"
    finally:
        if os.path.exists(part):
            os.unlink(part)
    good = status == "ok"
    return {"url": url, "path": path if good else None, "bytes": size if good else None, "sha256": digest.hexdigest() if good else None, "status": status}


def download_pdfs(rows: DataFrame, folder: str, most: int = 200 << 20, opener=urllib.request.urlopen) -> DataFrame:
    """(id, url, path, bytes, sha256, status) of each of ``rows`` (id, url); ids are file stems, ``folder`` is shared."""

    def run(frames):
        import pandas as pd

        os.makedirs(folder, exist_ok=True)
        for frame in frames:
            got = [fetch_pdf(u, os.path.join(folder, f"{i}.pdf"), most, opener) for i, u in zip(frame["id"], frame["url"], strict=True)]
            out = pd.DataFrame(got, columns=["url", "path", "bytes", "sha256", "status"])
            out.insert(0, "id", frame["id"].to_numpy())
            yield out.astype({"bytes": "Int64"})

    return rows.selectExpr("cast(id as string) id", "url").where("id is not null and url is not null").mapInPandas(run, STATUS)
