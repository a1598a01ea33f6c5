"""The command line: a program over files, which Spark reads, or over stdin, which the driver reads as it comes.

    python -m quern [options] PROGRAM [FILE...]

Exit codes: a halt's own, 5 if records failed, 2 for files or arguments that can't be read, 3 for a program that
doesn't compile; with -e 4 without output and 1 if the last was null or false.  Files of JSON may have any layout and
are read whole, a file a task; --lines says that they hold a record a line and may be split.
"""

from __future__ import annotations

import argparse
import functools
import os
import sys
from collections.abc import Iterator

from .functions import kernel
from .functions.reader import Reader
from .functions.values import FilterError, dumps
from .plans.parse import CompileError, parse
from .sources.records import Job, calls, evaluate, framed, read


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quern", description="Run a filter program over JSON.", allow_abbrev=False)
    p.add_argument("words", nargs="*", metavar="PROGRAM, FILE", help="the program (unless -f gives it), then files, or values with --args and --jsonargs")
    for short, name, text in (
        ("-n", "null-input", "run once on null"), ("-R", "raw-input", "lines are strings"), ("-s", "slurp", "all inputs as one array"), ("-r", "raw-output", "strings without quotes"),
        ("-j", "join-output", "raw, with nothing between outputs"), (None, "raw-output0", "raw, with NUL after each output"), ("-a", "ascii-output", "escape all but ASCII"), ("-S", "sort-keys", "print keys in order"),
        ("-C", "color-output", "coloured output"), ("-M", "monochrome-output", "no colours"), (None, "unbuffered", "flush after each output"), (None, "stream", "documents as events"),
        ("-e", "exit-status", "exit status by the last output"), (None, "args", "words after the program are strings"), (None, "jsonargs", "words after the program are JSON"), (None, "lines", "files hold a record a line and may be split"),
    ):
        p.add_argument(*filter(None, (short, f"--{name}")), action="store_true", help=text)
    # the last of the layouts counts
    p.add_argument("-c", "--compact-output", dest="layout", action="store_const", const=0)
    p.add_argument("--tab", dest="layout", action="store_const", const="\t")
    p.add_argument("--indent", dest="layout", type=int, metavar="N")
    p.add_argument("-f", "--from-file", metavar="FILE")
    for name in PAIRED:
        p.add_argument(f"--{name}", nargs=2, action="append", default=[], metavar=("NAME", "VALUE"))
    p.set_defaults(layout=2)
    return p


#: Options that take a name and a value.
PAIRED = ("arg", "argjson", "slurpfile", "rawfile")


class Refused(Exception):
    """Arguments that can't be used."""


def one(text: str, what: str):
    try:
        found = list(Reader(text).values())
    except FilterError as e:
        raise Refused(f"invalid JSON for {what}: {e.value}") from None
    if len(found) != 1:
        raise Refused(f"invalid JSON for {what}: not one value")
    return found[0]


def held(path: str, what: str) -> str:
    try:
        with open(path, encoding="utf-8", errors="replace", newline="") as f:
            return f.read()
    except OSError as e:
        raise Refused(f"cannot read {path} for {what}: {e.strerror}") from None


def variables(o: argparse.Namespace) -> dict:
    named: dict = dict(o.arg)
    named |= {k: one(t, f"--argjson {k}") for k, t in o.argjson}
    for k, path in o.slurpfile:
        try:
            named[k] = list(Reader(held(path, f"--slurpfile {k}")).values())
        except FilterError as e:
            raise Refused(f"cannot read {path} for --slurpfile {k}: {e.value}") from None
    return named | {k: held(path, f"--rawfile {k}") for k, path in o.rawfile}


def printed(v, indent, sort: bool, raw: bool, ascii_only: bool, colors: bool, nul: bool) -> str:
    if raw and isinstance(v, str) and not ascii_only:
        if nul and "\0" in v:
            raise FilterError("Cannot dump a string containing NUL with --raw-output0 option")
        return v
    return dumps(v, indent, sort, ascii_only, colors)


def here(paths: list[str], raw: bool) -> Iterator[tuple]:
    """(file, text) parts of streams that only the driver has: stdin, pipes, devices."""
    for path in paths or [None]:
        stream = sys.stdin.buffer if path is None else open(path, "rb")  # noqa: SIM115
        lines = (line.decode("utf-8", "replace") for line in stream)
        yield from ((path, t.removesuffix("\n") if raw else t) for t in (lines if raw else framed(lines)))


def rows_of(job: Job, paths: list[str], named_files: bool, lines: bool) -> Iterator[tuple]:
    if paths and all(os.path.isfile(p) or "://" in p for p in paths):
        from pyspark.sql import SparkSession

        from .api import interpret

        spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
        return map(tuple, interpret(spark, job, paths, not (lines or job.raw)).toLocalIterator(prefetchPartitions=True))
    if named_files and not paths:  # none could be opened
        return evaluate(job, lambda run: iter(()), lambda: iter(()))
    return evaluate(job, lambda run: read(here(paths, job.raw), job, run), lambda: (t for _, t in here(paths, False)))


def given(argv: list[str]) -> tuple[list[str], dict]:
    """The arguments without those options that take a name and a value, which may begin with a hyphen; and these by option."""
    rest, found, at = [], {k: [] for k in PAIRED}, 0
    while at < len(argv):
        name = argv[at].removeprefix("--")
        if argv[at] == "--":
            break
        if argv[at].startswith("--") and name in found and at + 2 < len(argv):
            found[name].append(argv[at + 1 : at + 3])
            at += 3
        else:
            rest.append(argv[at])
            at += 1
    return rest + argv[at:], found


def main(argv: list[str] | None = None) -> int:
    rest, pairs = given(sys.argv[1:] if argv is None else argv)
    o = options().parse_intermixed_args(rest)
    vars(o).update(pairs)
    say = functools.partial(print, file=sys.stderr)
    try:
        words, named = list(o.words), variables(o)
        program = held(o.from_file, "--from-file") if o.from_file else words.pop(0) if words else None
        if program is None:
            raise Refused('no program given (try ".")')
        if not isinstance(o.layout, str) and not 0 <= o.layout <= 7:
            raise Refused("cannot indent more than 7 characters")
        positional = [one(w, "--jsonargs") for w in words] if o.jsonargs else words if o.args else []
        tree = parse(program, kernel.known(), list(named))
    except (Refused, CompileError) as e:
        say(f"quern: error: {e}")
        return 3 if isinstance(e, CompileError) else 2
    files = [] if o.args or o.jsonargs else words
    kept = [p for p in files if os.path.exists(p) or "://" in p]
    for p in sorted(set(files) - set(kept)):
        say(f"quern: error: Could not open {p}: No such file or directory")
    raw = o.raw_output or o.join_output or o.raw_output0
    tty = sys.stdout.isatty()
    colors = not o.monochrome_output and (o.color_output or (tty and "NO_COLOR" not in os.environ))
    form = functools.partial(printed, indent=o.layout, sort=o.sort_keys, raw=raw, ascii_only=o.ascii_output, colors=colors, nul=o.raw_output0)
    mode = "null" if o.null_input else "slurp" if o.slurp else "each"
    environment = dict(os.environ) if calls(tree, {"env", "ENV"}) else {}
    job = Job(tree, mode, named, positional, {}, o.raw_input, o.stream, True, environment, form)
    after = "\0" if o.raw_output0 else "" if o.join_output else "\n"
    out, failed, last, halted = sys.stdout.buffer, False, None, None
    for value, error, note in rows_of(job, kept, bool(files), o.lines):
        if error is None:
            last = note != "false"
            out.write((value + after).encode("utf-8", "replace"))
            if o.unbuffered or tty:
                out.flush()
        elif note == "debug":
            say(error)
        elif note == "halt":
            code, _, text = error.removeprefix("halt ").partition(": ")
            sys.stderr.write(text)
            halted = int(code)
            break
        else:
            failed = True
            say(f"quern: error (at {note}): {error}")
    out.flush()
    if halted is not None:
        return halted
    if failed:
        return 5
    if len(kept) < len(files):
        return 2
    return 0 if not o.exit_status or last else 4 if last is None else 1
