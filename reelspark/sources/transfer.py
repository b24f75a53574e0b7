"""Driver-side transfer of archives: resumable downloads, guarded extraction, guarded clean-up."""

from __future__ import annotations

import os
import shutil
import time
import zipfile
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from urllib.error import URLError
from urllib.request import Request, urlopen


def fetch_text(url: str, snapshot: str | None = None, timeout: float = 30.0, opener=urlopen) -> tuple[str, str]:
    """(text, origin) of an address, kept as a snapshot; the snapshot where the address fails."""
    try:
        with opener(Request(url), timeout=timeout) as answer:
            text = answer.read().decode("utf-8-sig")
        if snapshot:
            Path(snapshot).parent.mkdir(parents=True, exist_ok=True)
            Path(snapshot).write_text(text, encoding="utf-8")
        return text, "live"
    except (URLError, OSError):
        if snapshot and os.path.exists(snapshot):
            return Path(snapshot).read_text(encoding="utf-8"), "snapshot"
        raise


def download(url: str, target: str, attempts: int = 4, chunk: int = 1 << 20, timeout: float = 60.0, opener=urlopen, sleep=time.sleep) -> int:
    """Download to ``target``, going on from a partial file where the server allows; the final size.

    A failed attempt is repeated after 1, 2, 4, ... seconds.
    """
    part = Path(f"{target}.part")
    part.parent.mkdir(parents=True, exist_ok=True)
    for attempt in range(attempts):
        have = part.stat().st_size if part.exists() else 0
        request = Request(url, headers={"Range": f"bytes={have}-"} if have else {})
        try:
            with opener(request, timeout=timeout) as answer:
                resumed = have and getattr(answer, "status", 200) == 206
                with part.open("ab" if resumed else "wb") as file:
                    shutil.copyfileobj(answer, file, chunk)
            os.replace(part, target)
            return os.path.getsize(target)
        except (URLError, OSError):
            if attempt == attempts - 1:
                raise
            sleep(2.0**attempt)
    raise RuntimeError("unreachable")


def download_all(pairs: list[tuple[str, str]], workers: int = 4, **options) -> list[tuple[str, int | None, str | None]]:
    """(target, size, error) of several downloads; one that fails does not stop the others."""

    def one(pair: tuple[str, str]):
        try:
            return pair[1], download(*pair, **options), None
        except Exception as error:  # noqa: BLE001
            return pair[1], None, str(error)

    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(one, pairs))


def member_target(root: Path, name: str) -> Path:
    """Where a member goes; ValueError for one that would leave ``root``."""
    target = (root / name.replace("\\", "/")).resolve()
    if name.startswith(("/", "\\")) or ":" in name.split("/")[0] or not target.is_relative_to(root.resolve()):
        raise ValueError(f"unsafe member {name!r}")
    return target


def extract(archive: str, root: str) -> tuple[int, int]:
    """(extracted, skipped) members; links and members outside ``root`` are an error, equal files are skipped."""
    base, done, skipped = Path(root), 0, 0
    with zipfile.ZipFile(archive) as z:
        members = [i for i in z.infolist() if not i.is_dir()]
        targets = [(i, member_target(base, i.filename)) for i in members]
        if any((i.external_attr >> 28) == 0xA for i in members):
            raise ValueError("the archive holds symbolic links")
        for info, target in targets:
            if target.exists() and target.stat().st_size == info.file_size:
                skipped += 1
                continue
            target.parent.mkdir(parents=True, exist_ok=True)
            with z.open(info) as source, open(f"{target}.tmp", "wb") as file:
                shutil.copyfileobj(source, file)
            os.replace(f"{target}.tmp", target)
            done += 1
    return done, skipped


def cleanup_plan(root: str, targets: list[str]) -> list[tuple[str, int]]:
    """(path, bytes) that a clean-up of folders below ``root`` would free; a target outside is an error."""
    base, out = Path(root).resolve(), []
    for name in targets:
        path = (base / name).resolve()
        if path == base or not path.is_relative_to(base):
            raise ValueError(f"{name!r} is not below {root!r}")
        if path.exists():
            files = [path] if path.is_file() else [p for p in path.rglob("*") if p.is_file() and not p.is_symlink()]
            out.append((str(path), sum(p.stat().st_size for p in files)))
    return out


def clean(root: str, targets: list[str], confirm: bool = False) -> list[tuple[str, int]]:
    """Carry a clean-up plan out; without ``confirm`` nothing is deleted."""
    plan = cleanup_plan(root, targets)
    if confirm:
        for path, _ in plan:
            shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)
    return plan


def media_path(manifest_path: str, data_root: str) -> Path:
    """The file a manifest row names, which must lie below the data root."""
    root = Path(data_root).resolve()
    path = (root / manifest_path).resolve()
    if not path.is_relative_to(root) or not path.is_file():
        raise FileNotFoundError(manifest_path)
    return path
