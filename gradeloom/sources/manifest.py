"""Manifests on the driver: pinned settings, digests of artifacts and chains from child to parent."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from gradeloom.functions.canonical import digest
from gradeloom.sources.io import read_object, write_json


class ManifestError(ValueError):
    """A manifest that doesn't hold."""


def file_digest(path: str | Path, chunk: int = 1 << 20) -> str:
    """sha256 of a file, read in chunks."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


def setting_differences(found: dict[str, Any], expected: dict[str, Any], fields: Iterable[str] | None = None) -> dict[str, tuple[Any, Any]]:
    """{field: (found, expected)} of the fields that differ; a missing one counts as None."""
    return {k: (found.get(k), expected.get(k)) for k in (fields or expected) if found.get(k) != expected.get(k)}


def nested_differences(found: Any, expected: Any, at: str = "") -> dict[str, tuple[Any, Any]]:
    """{dotted field: (found, expected)} of what differs below the fields of ``expected``; a missing one counts as None."""
    if not isinstance(expected, dict):
        return {} if found == expected and isinstance(found, bool) == isinstance(expected, bool) else {at: (found, expected)}
    inside = found if isinstance(found, dict) else {}
    return {k: v for name, want in expected.items() for k, v in nested_differences(inside.get(name), want, f"{at}.{name}" if at else name).items()}


def require_settings(value: dict[str, Any], expected: dict[str, Any], files: dict[str, str | Path] | None = None) -> dict[str, Any]:
    """A result that later work depends on, if it has the expected settings and the digests of ``files`` by dotted field."""
    wrong = nested_differences(value, expected)
    for field, path in (files or {}).items():
        recorded: Any = value
        for name in field.split("."):
            recorded = recorded.get(name) if isinstance(recorded, dict) else None
        if recorded != (now := file_digest(path)):
            wrong[field] = (recorded, now)
    if wrong:
        raise ManifestError(f"{wrong}")
    return value


def write_manifest(path: str | Path, kind: str, config: dict[str, Any], artifacts: dict[str, str | Path], **extra: Any) -> dict[str, Any]:
    """Write and return a manifest with the digests of its configuration and artifacts; reserved keys are kept safe."""
    body = {
        "stage": "complete", "kind": kind, "config": config, "config_hash": digest(config),
        "artifacts": {name: {"path": Path(p).name, "sha256": file_digest(p)} for name, p in artifacts.items()},
    }
    if taken := sorted(set(extra) & set(body)):
        raise ManifestError(f"reserved keys {taken}")
    write_json(path, body | extra)
    return body | extra


def verify_manifest(path: str | Path, kind: str, expected: dict[str, Any] | None = None) -> dict[str, Any]:
    """Load a manifest and hold its kind, stage, configuration and the files beside it against it."""
    m = read_object(path)
    if wrong := setting_differences(m, {"stage": "complete", "kind": kind}):
        raise ManifestError(f"{path}: {wrong}")
    if m.get("config_hash") != digest(m.get("config")):
        raise ManifestError(f"{path}: the configuration doesn't match its digest")
    if wrong := setting_differences(m["config"], expected or {}):
        raise ManifestError(f"{path}: {wrong}")
    for name, artifact in m.get("artifacts", {}).items():
        file = Path(path).parent / artifact["path"]
        if not file.exists() or file_digest(file) != artifact["sha256"]:
            raise ManifestError(f"{path}: artifact {name} is missing or changed")
    return m


def resolve_parent(child: dict[str, Any], parents: Iterable[dict[str, Any]], by: str = "parent_sha256", inherit_except: Iterable[str] = ()) -> dict[str, Any]:
    """The one manifest a child names by the digest of its content; what the child inherits must be equal."""
    found = [p for p in parents if digest(p) == child.get(by)]
    if len(found) != 1:
        raise ManifestError(f"{len(found)} manifests match {by}={child.get(by)!r}")
    parent = found[0]
    free = set(inherit_except)
    if wrong := setting_differences(child.get("config", {}), {k: v for k, v in parent.get("config", {}).items() if k not in free}):
        raise ManifestError(f"settings differ from the parent's: {wrong}")
    return parent


def newest_complete(states: Iterable[dict[str, Any]], contract: dict[str, Any]) -> dict[str, Any] | None:
    """The state of the largest step whose files are all there and whose contract is equal; None if there is none."""
    fit = [s for s in states if s.get("complete") and not setting_differences(s.get("contract", {}), contract)]
    return max(fit, key=lambda s: s["step"], default=None)
