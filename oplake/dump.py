"""Text dumps of native files, one escaped item a line."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from typing import TextIO

from oplake.errors import Corruption, InvalidArgument, IoError, OplakeError
from oplake.functions.coding import escape_bytes
from oplake.sources import native

KIND = {0: "deletion", 1: "value"}
USAGE = "usage: oplake --help | oplake dump FILE...\n"


def _quoted(data: bytes | str) -> str:
    return "'" + escape_bytes(data if isinstance(data, bytes) else data.encode("utf-8", "surrogateescape")) + "'"


def _internal(key: bytes) -> str:
    user_key, sequence, kind = native.parse_internal_key(key)
    return f"{{user_key={_quoted(user_key)} sequence={sequence} kind={KIND[kind]}}}"


def dump_file(path: str, write: Callable[[str], object]) -> None:
    """Writes the dump line by line.  What can be read is written; the first fault is raised at the end."""
    named = native.parse_file_name(os.path.basename(path))
    if named is None or named[0] not in ("log", "manifest", "table"):
        raise InvalidArgument("file name is not that of a log, manifest or table")
    kind = named[0]
    try:
        with open(path, "rb") as f:
            data = f.read()
    except OSError as why:
        raise IoError(str(why)) from None
    table = native.TableReader(data) if kind == "table" else None
    write(f"dump version=1 type={kind} file={_quoted(path.replace(os.sep, '/'))}\n")
    faults: list[OplakeError] = []
    if table is not None:
        _dump_table(table, write, faults)
    else:
        for item in native.read_log(data):
            if isinstance(item, native.LogCorruption):
                faults.append(item.error)
                write(f"corruption offset={item.offset} dropped_bytes={item.dropped_bytes} error={_quoted(str(item.error))}\n")
                continue
            try:
                lines = _batch(item) if kind == "log" else _edit(item)
            except OplakeError as why:
                fault = Corruption(f"invalid {'WAL' if kind == 'log' else 'MANIFEST'} record at offset {item.offset}: {why}")
                faults.append(fault)
                write(f"record_error offset={item.offset} error={_quoted(str(fault))}\n")
                continue
            for line in lines:
                write(line + "\n")
    if faults:
        raise faults[0]


def _batch(item: native.LogRecord) -> list[str]:
    first, ops = native.decode_batch(item.data)
    out = [f"record offset={item.offset} sequence={first} count={len(ops)}"]
    for i, (kind, key, value) in enumerate(ops):
        tail = f" value={_quoted(value)}" if kind else ""
        out.append(f"  {'put' if kind else 'delete'} sequence={first + i} key={_quoted(key)}{tail}")
    return out


def _edit(item: native.LogRecord) -> list[str]:
    e = native.VersionEdit.decode(item.data)
    out = [f"record offset={item.offset}"]
    if e.comparator is not None:
        out.append(f"  comparator name={_quoted(e.comparator)}")
    for name in ("log_number", "previous_log_number", "next_file_number", "last_sequence"):
        if (value := getattr(e, name)) is not None:
            out.append(f"  {name} value={value}")
    out += [f"  compact_pointer level={level} key={_internal(key)}" for level, key in e.compact_pointers]
    out += [f"  delete_file level={level} number={number}" for level, number in sorted(e.deleted_files)]
    out += [f"  add_file level={level} number={number} size={size} smallest={_internal(low)} largest={_internal(high)}" for level, number, size, low, high in e.new_files]
    return out


def _dump_table(table: native.TableReader, write: Callable[[str], object], faults: list[OplakeError]) -> None:
    try:
        for key, value in table.entries():
            try:
                user_key, sequence, kind = native.parse_internal_key(key)
            except OplakeError as why:
                faults.append(why)
                write(f"bad_key encoded={_quoted(key)} value={_quoted(value)}\n")
            else:
                write(f"entry user_key={_quoted(user_key)} sequence={sequence} kind={KIND[kind]} value={_quoted(value)}\n")
    except OplakeError as why:
        faults.append(why)


def main(arguments: list[str], out: TextIO = sys.stdout, err: TextIO = sys.stderr) -> int:
    """Exit code: 0 all well, 1 an input or output failed, 2 wrong usage.  A failed input is
    reported and the next one dumped; a failed output ends the run."""
    if arguments == ["--help"]:
        out.write(USAGE)
        return 0
    if len(arguments) < 2 or arguments[0] != "dump" or any(a.startswith("-") for a in arguments[1:]):
        err.write(USAGE)
        return 2
    failed = False
    for path in arguments[1:]:
        try:
            dump_file(path, out.write)
        except OplakeError as why:
            failed = True
            err.write(f"{_quoted(path)}: {escape_bytes(str(why).encode())}\n")
        except OSError:
            return 1
    return int(failed)
