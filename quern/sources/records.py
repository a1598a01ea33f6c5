"""Evaluation of a program over records, wherever they are read: in a task's batches or on the driver.

Rows of a result are (value, error, note).  The note of a value is "false" if it is null or false, that of an
error its place ("file:lines read"), and "halt" or "debug" mark the rows that those functions make.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from ..functions import kernel
from ..functions.reader import Reader
from ..functions.values import FilterError, dumps, truthy

MARK = re.compile(r'\\.|["\[\]{}]', re.S)


@dataclass
class Job:
    """A parsed program and how it is to be run; sent to the tasks as it is."""

    tree: tuple
    mode: str = "each"
    named: dict = field(default_factory=dict)
    positional: list = field(default_factory=list)
    tables: dict = field(default_factory=dict)  # variables that aren't arguments
    raw: bool = False
    stream: bool = False
    notes: bool = False
    environment: dict | None = None
    form: Callable = dumps


def calls(tree, names: set) -> bool:
    """Whether a program calls one of the functions or reads one of the variables."""
    if not isinstance(tree, tuple):
        return False
    return (len(tree) > 1 and tree[0] in ("call", "var") and isinstance(tree[1], str) and tree[1] in names) or any(calls(x, names) for x in tree)


def framed(lines: Iterable[str]) -> Iterator[str]:
    """Texts of whole lines that end outside strings and brackets, as early as they can."""
    held, depth, inside = [], 0, False
    for line in lines:
        held.append(line)
        for m in MARK.finditer(line):
            c = m[0]
            if c == '"':
                inside = not inside
            elif not inside:
                depth += (c in "[{") - (c in "]}")
        if depth <= 0 and not inside:
            yield "".join(held)
            held, depth = [], 0
    if held:
        yield "".join(held)


def read(parts: Iterable[tuple], job: Job, run: kernel.Run) -> Iterator[tuple]:
    """(value, error) of the records of (file, text) parts; the run is told the file and the lines read.

    A text that can't be read further ends with its error, and later texts are read on.
    """
    for file, text in parts:
        if file != run.filename:
            run.filename, run.line = file, 0
        if job.raw:
            run.line += 1
            yield text, None
            continue
        reader, before, seen = Reader(text), run.line, 0
        found = reader.events() if job.stream else reader.values()
        while True:
            try:
                v, error = next(found), None
            except StopIteration:
                break
            except FilterError as e:
                v, error = None, e.value
            end = min(len(text), reader.at + (text[reader.at : reader.at + 1] == "\n"))
            run.line += text.count("\n", seen, end)
            seen = max(seen, end)
            yield v, error
        run.line = before + text.count("\n")


def outputs(job: Job, env: kernel.Env, v, place: str | None = None) -> Iterator[tuple]:
    """Rows of one evaluation: what came before an error stays."""
    run = env.run

    def messages():
        told, run.messages = run.messages, []
        return [(None, dumps(m), "debug") for m in told] if job.notes else []

    row = None
    try:
        for x in kernel.values(job.tree, env, v):
            yield from messages() if run.messages else ()
            yield job.form(x), None, None if truthy(x) else "false"
    except FilterError as e:
        row = None, e.value if isinstance(e.value, str) else f"(not a string): {dumps(e.value)}", place
    except kernel.Break:
        row = None, "break", place
    except kernel.Halt as h:
        row = None, f"halt {h.code}: {h.value if isinstance(h.value, str) else dumps(h.value) + chr(10)}", "halt"
    except RecursionError:
        row = None, "the program nests too deeply", place
    except Exception as e:  # no record may end the job
        row = None, f"{type(e).__name__}: {e}", place
    yield from messages() if run.messages else ()
    if row:
        yield row


def evaluate(job: Job, feed: Callable[[kernel.Run], Iterator[tuple]], texts: Callable[[], Iterator[str]] | None = None) -> Iterator[tuple]:
    """Rows of a job over what feed(run) reads, or over one text of raw slurped input."""
    run = kernel.Run(named=job.named, positional=job.positional, environment=job.environment)
    env = run.env().bind(job.tables)
    if texts is not None and job.mode == "slurp" and job.raw:
        yield from outputs(job, env, "".join(texts()), "<unknown>")
        return
    pending = feed(run)

    def further():
        for v, error in pending:
            if error is not None:
                raise FilterError(error)
            yield v

    run.inputs = further()
    if job.mode == "null":
        yield from outputs(job, env, None, "<unknown>")
    elif job.mode == "slurp":
        try:
            every = list(run.inputs)
        except FilterError as e:
            yield None, e.value, "<unknown>"
        else:
            yield from outputs(job, env, every, "<unknown>")
    else:
        for v, error in pending:
            place = f"{run.filename or '<stdin>'}:{run.line}"
            if error is not None:
                yield None, error, place
                continue
            for row in outputs(job, env, v, place):
                yield row
                if row[2] == "halt":
                    return
