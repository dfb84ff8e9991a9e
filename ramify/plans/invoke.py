"""Plans that are run without waiting for them: each is an action of its own, whose result is withdrawn later."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor, as_completed

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from ..storage import written


def invoke(plans: dict[str, DataFrame], at_once: int = 4) -> Iterator[tuple[str, DataFrame]]:
    """Runs plans, at_once of them at a time, and gives (name, its result as a written table) as each is done.

    The scheduler shares the cluster among them; a plan that fails raises when its turn to be withdrawn comes, after the others
    have ended. No plans: nothing.
    """
    if at_once < 1:
        raise ValueError("at least one plan runs at a time")
    with ThreadPoolExecutor(at_once) as pool:
        running: dict[Future[DataFrame], str] = {pool.submit(inheritable_thread_target(df.sparkSession)(written), df, name): name for name, df in plans.items()}
        for done in as_completed(running):
            yield running[done], done.result()
