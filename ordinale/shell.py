"""The interactive shell and pipe mode.

    python -m ordinale.shell            reads statements, one a line
    echo '+/!1000000' | python -m ordinale.shell

Lines that begin with a backslash or colon are commands; in pipe mode lines that begin
with a slash are comments. Ctrl-C cancels the running statement and keeps the session.
"""

from __future__ import annotations

import atexit
import contextlib
import itertools
import os
import sys
import threading
import time
from typing import TextIO

from pyspark.sql import SparkSession

from .errors import Cancelled, OrdinaleError
from .formatting import shown
from .plans.session import Session

HELP = """\\t expr   evaluate and show the time taken
\\v        names that are bound
\\p [0|1]  show or set whether shuffles are parallel
\\h \\?     this text
\\\\ :q     leave"""
#: Lines of history that are kept.
HISTORY = 10_000
_tags = itertools.count()


class Progress:
    """Tasks done so far of the running statement, its seconds and tasks a second, on one line that is written again every so often."""

    def __init__(self, spark: SparkSession, out: TextIO, every: float = 0.5):
        self.tracker, self.out, self.every, self.stop = spark.sparkContext.statusTracker(), out, every, threading.Event()
        self.begin, self.seen, self.rate = time.perf_counter(), {}, 0.0
        self.last = self.begin, 0

    def line(self) -> str | None:
        done = total = 0
        for stage in self.tracker.getActiveStageIds():
            info = self.tracker.getStageInfo(stage)
            if info is not None:
                done, total = done + info.numCompletedTasks, total + info.numTasks
                self.seen[stage] = info.numCompletedTasks
        if not total:
            return None
        now, all_done = time.perf_counter(), sum(self.seen.values())
        (before, had), self.last = self.last, (now, all_done)
        if now > before:  # smoothed, as tasks end in bursts
            self.rate += 0.3 * ((all_done - had) / (now - before) - self.rate)
        return f"{done} of {total} tasks  {now - self.begin:.1f} s  {self.rate:.1f} tasks/s  [^C] cancels"

    def __enter__(self) -> Progress:
        def run() -> None:
            while not self.stop.wait(self.every):
                if text := self.line():
                    self.out.write(f"\r{text}\x1b[K")
                    self.out.flush()

        self.thread = threading.Thread(target=run, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *error: object) -> None:
        self.stop.set()
        self.thread.join()
        self.out.write("\r\x1b[K")


class Shell:
    def __init__(self, spark: SparkSession, out: TextIO = sys.stdout, err: TextIO = sys.stderr, columns: int | None = None, progress: bool = False):
        self.spark, self.out, self.err, self.columns, self.progress = spark, out, err, columns, progress
        self.session = Session(spark)
        self.partitions = spark.conf.get("spark.sql.shuffle.partitions")

    def evaluate(self, source: str) -> str:
        """The result as text. An interrupt cancels the statement's jobs and no others."""
        tag = f"ordinale-{next(_tags)}"
        self.spark.sparkContext.addJobTag(tag)
        try:
            with Progress(self.spark, self.err) if self.progress else contextlib.nullcontext():
                return shown(self.session.eval(source), self.spark, self.columns)
        except KeyboardInterrupt:
            self.spark.sparkContext.cancelJobsWithTag(tag)
            raise Cancelled("cancelled") from None
        finally:
            self.spark.sparkContext.removeJobTag(tag)

    def line(self, text: str) -> bool:
        """Handle one line; False if it asks to leave."""
        text = text.strip()
        if text in ("\\\\", ":q"):
            return False
        try:
            if text.startswith(("\\", ":")):
                self.command(text)
            elif text:
                self.out.write(self.evaluate(text) + "\n")
        except OrdinaleError as e:
            self.err.write(f"{type(e).__name__}: {e}\n")
        except Exception as e:  # a job that failed, a shape that didn't fit
            self.err.write(f"{type(e).__name__}: {str(e).splitlines()[0]}\n")
        return True

    def command(self, text: str) -> None:
        name, _, rest = text.partition(" ")
        if name == "\\t" and rest:
            begin = time.perf_counter()
            result = self.evaluate(rest)
            self.out.write(f"{result}\n{(time.perf_counter() - begin) * 1000:.3f} ms\n")
        elif name == "\\v":
            self.out.write("".join(f"{n}\n" for n in sorted(self.session.names)))
        elif name == "\\p":
            if rest in ("0", "1"):
                self.spark.conf.set("spark.sql.shuffle.partitions", "1" if rest == "0" else self.partitions)
            elif rest:
                raise OrdinaleError("\\p takes 0 or 1")
            on = self.spark.conf.get("spark.sql.shuffle.partitions") != "1"
            self.out.write(f"parallel {int(on)}, {self.spark.sparkContext.defaultParallelism} cores\n")
        elif name in ("\\h", "\\?", ":h"):
            self.out.write(HELP + "\n")
        else:
            raise OrdinaleError(f"unknown command {name}")

    def pipe(self, lines: TextIO) -> None:
        for text in lines:
            if not text.lstrip().startswith("/") and not self.line(text):
                return

    def interact(self) -> None:
        held: list[str] = []
        while True:
            try:
                held.append(input("  " if not held else "   "))
            except EOFError:
                return
            except KeyboardInterrupt:
                held.clear()
                continue
            text = "\n".join(held)
            if open_brackets(text):
                continue
            held.clear()
            if not self.line(text):
                return

    def complete(self, text: str, at: int) -> str | None:
        """The name or command number `at` that begins with `text`."""
        fits = [n for n in (*sorted(self.session.names), "\\t", "\\v", "\\p", "\\h", "\\\\") if n.startswith(text)]
        return fits[at] if at < len(fits) else None


def open_brackets(text: str) -> bool:
    """Whether a bracket or a string is still open, so that the statement goes on in the next line."""
    depth, quoted, skip = 0, False, False
    for c in text:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        else:
            depth += (c in "([{") - (c in ")]}")
    return depth > 0 or quoted


def line_editing(shell: Shell) -> None:
    """History of HISTORY lines over sessions, and completion of names; without the readline module neither."""
    with contextlib.suppress(ImportError):
        import readline

        path = os.path.expanduser(os.environ.get("ORDINALE_HISTORY", "~/.ordinale_history"))
        with contextlib.suppress(OSError):
            readline.read_history_file(path)
        readline.set_history_length(HISTORY)
        readline.set_completer(shell.complete)
        readline.parse_and_bind("tab: complete")

        def keep() -> None:
            with contextlib.suppress(OSError):
                readline.write_history_file(path)

        atexit.register(keep)


def main() -> None:
    spark = SparkSession.builder.appName("ordinale").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if sys.stdin.isatty():
        shell = Shell(spark, progress=True)
        line_editing(shell)
        shell.interact()
    else:
        Shell(spark).pipe(sys.stdin)


if __name__ == "__main__":
    main()
