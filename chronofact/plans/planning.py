"""Order of dependent view builds: layers whose members need only earlier layers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor, wait


def layers(needs: dict[str, Iterable[str]]) -> list[list[str]]:
    """needs: task -> tasks before it. Tasks whose needs can't be met are left out."""
    done: set[str] = set()
    out = []
    while ready := sorted(t for t, before in needs.items() if t not in done and set(before) <= done):
        out.append(ready)
        done |= set(ready)
    return out


def run_layers(needs: dict[str, Iterable[str]], build: Callable[[str], object], threads: int = 4) -> dict[str, object]:
    """Builds of a layer are submitted together, so their Spark jobs share the cluster."""
    results: dict[str, object] = {}
    with ThreadPoolExecutor(threads) as pool:
        for layer in layers(needs):
            jobs = {t: pool.submit(build, t) for t in layer}
            wait(jobs.values())
            results |= {t: j.result() for t, j in jobs.items()}
    return results


def cancelled_after(spark, seconds: float, group: str, body: Callable[[], object], otherwise=None):
    """body(), or otherwise if it takes too long; its Spark jobs are cancelled then."""
    from threading import Timer

    late: list[bool] = []

    def stop() -> None:
        late.append(True)
        spark.sparkContext.cancelJobGroup(group)

    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
    timer = Timer(seconds, stop)
    timer.start()
    try:
        return body()
    except Exception:
        if late:
            return otherwise
        raise
    finally:
        timer.cancel()
