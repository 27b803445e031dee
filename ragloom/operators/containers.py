"""Admission of container entries: an order-dependent fold, streamed through one root container after the other."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.files import ARCHIVE_EXTENSIONS, CONTENT_TYPES, MAIL_EXTENSIONS, SUPPORTED_EXTENSIONS
from ..params import ContainerLimits
from .index import BLOCKED, COMPLETED, PENDING, QUEUED, REJECTED, UNSUPPORTED

CHILD = "root_id long, container_id long, ordinal long, container_path string, file_name string, content_type string, size_bytes long, state int, extraction_state int, nesting_level int, is_container boolean, has_warnings boolean"


def clean_path(p: str | None) -> str:
    return (p or "").replace("\\", "/").strip().lstrip("/")


def _extension(name: str) -> str:
    low = name.lower()
    if low.endswith(".tar.gz"):
        return ".tar.gz"
    dot = low.rfind(".")
    return low[dot:] if 0 <= dot < len(low) - 1 else ""


def _split(path: str) -> tuple[str, str, str]:
    """Folder with its slash, base and extension of a path."""
    folder, slash, name = path.rpartition("/")
    dot = name.rfind(".")
    base, ext = (name[:dot], name[dot:]) if 0 <= dot < len(name) - 1 else (name[:-1] if name.endswith(".") else name, "")
    return (folder + slash if folder else ""), base, ext


def free_path(path: str, known: set[str], tried: dict[str, int]) -> str:
    """``path``, or with ' (2)', ' (3)' ... before its extension, the first not known (case aside).
    tried: the last number looked at for each path; numbers up to there are taken."""
    low = path.lower()
    candidate = path
    if low in known:
        folder, base, ext = _split(path)
        i = tried.get(low, 1)
        while candidate.lower() in known:
            i += 1
            candidate = f"{folder}{base} ({i}){ext}"
        tried[low] = i
    known.add(candidate.lower())
    return candidate


_NUMBERED = re.compile(r"(?: \([0-9]+\))+(?=\.|$)")


def _family(path: str) -> str:
    """What all paths share that may stand in each other's way: the path without the numbers before its dots
    and its end, and without dots at the end. A number that is put before an extension changes nothing of it, wherever
    the extension of the other name begins."""
    folder, slash, name = path.lower().rpartition("/")
    return folder + slash + _NUMBERED.sub("", name).rstrip(".")


def unique_paths(entries: DataFrame) -> DataFrame:
    """(container_id, ordinal, path) with unique_path: entries of a container in order, each at its
    cleaned path or the first free variant of it (case aside); entries without a path are left out.

    Only paths that are alike but for numbers can meet, so the entries are dealt by those; a task
    streams through its entries in order and remembers the paths of one such family.
    """
    kinds = dict(entries.dtypes)

    def named(batches):
        for rows in batches:
            rows["cleaned"] = rows["path"].map(clean_path)
            rows = rows[rows["cleaned"] != ""]
            yield rows.assign(family=rows["cleaned"].map(_family))

    def fold(batches):
        last, known, tried = None, set(), {}
        for rows in batches:
            out = []
            for container, family, path in zip(rows["container_id"], rows["family"], rows["cleaned"]):
                if (container, family) != last:
                    last, known, tried = (container, family), set(), {}
                out.append(free_path(path, known, tried))
            yield rows[["container_id", "ordinal", "path"]].assign(unique_path=out)

    base = f"container_id {kinds['container_id']}, ordinal {kinds['ordinal']}, path string"
    dealt = entries.select("container_id", "ordinal", "path").mapInPandas(named, f"{base}, cleaned string, family string")
    dealt = dealt.repartition("container_id", "family").sortWithinPartitions("container_id", "family", "ordinal", "path")
    return dealt.mapInPandas(fold, f"{base}, unique_path string")


_FIELDS = [f.split()[0] for f in CHILD.split(", ")]


class _Root:
    """What a root container holds so far; its rows wait for the warning that counts for all of them."""

    def __init__(self, root_id, files: int, total: int):
        self.root_id, self.files, self.total = root_id, files, total
        self.rows, self.warn = [], False
        self.stopped: set = set()
        #: by container: names that are taken, numbers tried, paths stored before
        self.known: dict[int, set[str]] = {}
        self.tried: dict[int, dict[str, int]] = {}
        self.stored: dict[int, set[str]] = {}

    def admit(self, e, limits: ContainerLimits) -> None:
        if e.container_id in self.stopped:
            return
        left = limits.max_total_bytes - self.total
        if self.files >= limits.max_files or left <= 0:
            self.warn = True
            self.stopped.add(e.container_id)
            return
        path = clean_path(e.path)
        if not path:
            return
        if e.container_id not in self.stored:
            self.stored[e.container_id] = {p.lower() for p in (e.stored_paths if e.stored_paths is not None else ())}
            self.known[e.container_id] = set(self.stored[e.container_id])
        path = "/".join(x for x in (clean_path(e.container_path), path) if x)
        if path.lower() in self.stored[e.container_id]:
            return
        level = int(e.container_level) + 1
        blocked = level > limits.max_depth or bool(e.is_encrypted) or e.size_bytes > limits.max_entry_bytes
        if not blocked and e.size_bytes > left:
            self.warn = True
            self.stopped.add(e.container_id)
            return
        path = free_path(path, self.known[e.container_id], self.tried.setdefault(e.container_id, {}))
        name = path.rpartition("/")[2]
        ext = _extension(name)
        kind = CONTENT_TYPES.get(ext, "application/octet-stream")
        self.files += 1
        if blocked:
            self.warn = True
            state, extraction, size = REJECTED, BLOCKED, 0
        else:
            state, extraction = (QUEUED, PENDING) if ext in SUPPORTED_EXTENSIONS or kind in _KNOWN_TYPES else (COMPLETED, UNSUPPORTED)
            size = int(e.size_bytes)
            self.total += size
        box = not blocked and ext in (*ARCHIVE_EXTENSIONS, *MAIL_EXTENSIONS)
        self.rows.append((e.root_id, e.container_id, e.ordinal, path, name, kind, size, state, extraction, level, box))


_KNOWN_TYPES = frozenset(CONTENT_TYPES.values())


def _admitted(limits: ContainerLimits):
    """Streams through the entries of one root after the other."""

    def run(batches):
        root, done = None, []

        def ended():
            if root is not None:
                done.extend((*r, root.warn) for r in root.rows)

        for entries in batches:
            for e in entries.itertuples(index=False):
                if root is None or e.root_id != root.root_id:
                    ended()
                    root = _Root(e.root_id, int(e.root_files), int(e.root_bytes))
                    if len(done) > 10_000:
                        yield pd.DataFrame(done, columns=_FIELDS)
                        done.clear()
                root.admit(e, limits)
        ended()
        yield pd.DataFrame(done, columns=_FIELDS)

    return run


def admit_container_entries(entries: DataFrame, limits: ContainerLimits | None = None) -> DataFrame:
    """Child documents of the entries, in order, under the limits of their root container.

    entries: root_id, container_id, container_order, container_path, container_level, ordinal, path,
    size_bytes, is_encrypted, root_files and root_bytes (what the root holds already), stored_paths.
    Archives and mails share the rules. The limits are tested before an entry is looked at, so blank and
    stored entries past them warn too: every entry goes through the fold, in a stream; a task
    holds the rows of one root at a time, max_files at most.
    """
    limits = (limits or ContainerLimits()).floored()
    return entries.repartition("root_id").sortWithinPartitions("root_id", "container_order", "ordinal").mapInPandas(_admitted(limits), CHILD)
