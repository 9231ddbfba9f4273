"""Named reader profiles and model files, kept by digest."""

from __future__ import annotations

import json
import re
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lectern.functions.identity import compact_digest
from lectern.sources.sinks import SinkError, atomic_write, report_json

MEMBERS = {"name", "reader", "version", "command", "settings", "timeout_s"}
NAME = re.compile(r"[a-z0-9][a-z0-9_-]{0,63}")


def profile_digest(profile: dict) -> str:
    return compact_digest({k: v for k, v in profile.items() if k != "sha256"})


def save_profile(folder: str | Path, profile: dict) -> str:
    """Writes a profile with its digest; only known members, only plain names."""
    if set(profile) - MEMBERS or not NAME.fullmatch(profile.get("name", "")):
        raise SinkError("PROFILE", "unknown members or a bad name")
    sha = profile_digest(profile)
    atomic_write(Path(folder, f"{profile['name']}.json"), report_json(profile | {"sha256": sha}))
    return sha


def load_profile(folder: str | Path, name: str) -> dict:
    if not NAME.fullmatch(name):
        raise SinkError("PROFILE", "a bad name")
    out = json.loads(Path(folder, f"{name}.json").read_text())
    if out.get("sha256") != profile_digest(out):
        raise SinkError("PROFILE", "the profile is not what its digest says")
    return out


def profiles(spark: SparkSession, folder: str | Path) -> DataFrame:
    """name, reader, version, sha256, good of every stored profile."""
    rows = []
    for path in sorted(Path(folder).glob("*.json")):
        p = json.loads(path.read_text())
        rows.append((p.get("name"), p.get("reader"), p.get("version"), p.get("sha256"), p.get("sha256") == profile_digest(p)))
    return spark.createDataFrame(rows, "name string, reader string, version string, sha256 string, good boolean")


def prepare_models(manifest: dict[str, str], source: str | Path, cache: str | Path) -> list[str]:
    """Copies the named files whose SHA-256 the manifest says into a cache; anything else is refused before it is there."""
    import hashlib

    out = []
    for name, sha in sorted(manifest.items()):
        if "/" in name or "\\" in name or name.startswith("."):
            raise SinkError("MODEL", f"refused name {name}")
        path = Path(source, name)
        if hashlib.sha256(path.read_bytes()).hexdigest() != sha:
            raise SinkError("MODEL", f"{name} is not what the manifest says")
        shutil.copyfile(path, Path(cache, f".{name}.new"))
        Path(cache, f".{name}.new").replace(Path(cache, name))
        out.append(name)
    return out
