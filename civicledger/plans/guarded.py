"""Checks that run side by side, each with a time limit and an answer of its own: rows, or what went wrong.

Every check is a thread that plans and runs its DataFrame under a tag. A check that fails while it runs, or that takes
too long and is then cancelled by its tag, is one row that says so; the others go on and keep their answers.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROWS = 500


def run_checks(spark: SparkSession, checks: dict[str, Callable[[], DataFrame]], seconds: float = 60.0, rows: int = ROWS) -> list[dict]:
    """(check, ok, rows, error, seconds) of each check, in their order; `rows` rows of each at most.

    The limit is each check's own, from the start. A check that hangs outside of Spark's jobs is given up as well; its
    thread is a daemon, and what it may still bring is dropped.
    """
    from pyspark import InheritableThread

    context, said, began = spark.sparkContext, {}, time.monotonic()
    lock, run = threading.Lock(), uuid.uuid4().hex[:8]
    tags = {name: f"check-{run}-{i}" for i, name in enumerate(checks)}

    def answer(name: str, make: Callable[[], DataFrame]) -> None:
        context.addJobTag(tags[name])
        try:
            found = {"ok": True, "rows": [r.asDict(True) for r in make().limit(rows).collect()], "error": None}
        except Exception as e:  # whatever it is, it is this check's alone
            found = {"ok": False, "rows": [], "error": f"{type(e).__name__}: {str(e).strip().splitlines()[0][:300] if str(e).strip() else ''}"}
        with lock:
            said.setdefault(name, found | {"seconds": round(time.monotonic() - began, 3)})

    threads = {}
    for name, make in checks.items():
        threads[name] = InheritableThread(target=answer, args=(name, make), daemon=True)
        threads[name].start()
    for name, thread in threads.items():
        thread.join(max(0.0, began + seconds - time.monotonic()))
        with lock:
            late = name not in said
            if late:
                said[name] = {"ok": False, "rows": [], "error": f"took more than {seconds:g} s", "seconds": round(time.monotonic() - began, 3)}
        if late:
            context.cancelJobsWithTag(tags[name])
    return [{"check": name, **said[name]} for name in checks]
