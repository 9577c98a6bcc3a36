"""An external scorer over JSON lines: {i, s, d} in, {i, ok, err} out, one process per partition."""

from __future__ import annotations

import json
import subprocess
import tempfile
import time
from collections.abc import Iterator
from threading import Thread

import pandas as pd
from pyspark.sql import DataFrame

#: Answered formulas that are handed on together.
CHUNK = 4096
FORM = "tex string, display boolean, ok boolean, err string"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["tex", "display", "ok", "err"]).astype({"ok": object, "err": object})


def scored(formulas: DataFrame, command: list[str], timeout_s: float = 600) -> DataFrame:
    """tex, display, ok, err of each distinct formula.

    The process lives as long as its partition: a thread feeds it, answers are
    read as they come, in any order, and only formulas without an answer are
    held.  Lines that are no answer are skipped; a formula without an answer
    when the process ends well has a null ok.  A process that fails, or says
    nothing for `timeout_s` seconds, fails the task with the end of its stderr,
    and Spark runs the partition again.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next(parts, None)
        if first is None:
            return
        errors = tempfile.TemporaryFile()
        p = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=errors, text=True)
        asked: dict[int, tuple[str, bool]] = {}
        failed: list[BaseException] = []
        heard = time.monotonic()

        def feed() -> None:
            i, open_ = 0, True
            try:
                pdf = first
                while pdf is not None:
                    for tex, display in zip(pdf["tex"], pdf["display"], strict=True):
                        asked[i] = (tex, bool(display))
                        try:
                            if open_:
                                p.stdin.write(json.dumps({"i": i, "s": tex, "d": bool(display)}) + "\n")
                        except BrokenPipeError:  # its exit code will tell
                            open_ = False
                        i += 1
                    pdf = next(parts, None)
                if open_:
                    p.stdin.close()
            except BrokenPipeError:
                pass
            except BaseException as e:
                failed.append(e)
                p.kill()

        def watch() -> None:
            while p.poll() is None:
                if time.monotonic() - heard > timeout_s:
                    failed.append(TimeoutError(f"the scorer {command[0]} said nothing for {timeout_s} seconds"))
                    p.kill()
                time.sleep(min(1.0, timeout_s))

        feeder = Thread(target=feed, daemon=True)
        feeder.start()
        Thread(target=watch, daemon=True).start()
        done = []
        try:
            for line in p.stdout:
                heard = time.monotonic()
                try:
                    v = json.loads(line)
                    i, ok, err = int(v["i"]), bool(v["ok"]), v.get("err")
                except (ValueError, KeyError, TypeError):
                    continue
                if i in asked:
                    done.append((*asked.pop(i), ok, err))
                if len(done) >= CHUNK:
                    yield _frame(done)
                    done = []
            code = p.wait()
            feeder.join()
            if failed:
                raise failed[0]
            if code:
                errors.seek(0)
                raise RuntimeError(f"the scorer {command[0]} ended with {code}: {errors.read()[-500:].decode(errors='replace')}")
            yield _frame(done + [(*q, None, None) for q in asked.values()])
        finally:
            p.kill()
            errors.close()

    return formulas.select("tex", "display").distinct().mapInPandas(run, FORM)
