"""The stored tables and the questions that are asked of them, each answered with a DataFrame.

Tables are Parquet, written by column name, in folders by day, then granularity (of rollups), then batch: a time range lists and reads the days it
covers, and a coarse question never opens the fine windows. A batch done again replaces its own rows.

A stream makes a folder for each micro-batch. ``tidy`` puts ``FAN`` folders of one level together to one of the next, so a row is written again once a
level, a logarithm of the number of batches, and a day has few folders. A folder of a level stands for all lower ones with numbers up to its own, from the moment that its
mark is there, which is written last: readers see the old folders or the new one, never both or a part. The old ones are deleted later, when no reader has them
open any more. ``compact`` puts all of a day together at once.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import gauge, listing, metrics, predicates, proxy, services, sketches, turns

#: Days that each table and granularity is kept; 0 keeps all.
RETENTION_DAYS = {"spans": 7, "traces": 30, "trace_patches": 30, "http_exchanges": 7, "10s": 1, "1m": 7, "5m": 30, "1h": 365}
DAY_US = 86_400_000_000
#: The time column of each table, by whose day it is partitioned.
TABLES = {"spans": "request_us", "traces": "start_us", "trace_patches": "start_us", "http_exchanges": "request_us", "llm_metrics": "window_us", "llm_finish_metrics": "window_us", "llm_active": "window_us"}
#: Times by which rows grow old, where it is another column.
AGES = {"traces": "end_us"}
#: Tables with a granularity.
ROLLED = ("llm_metrics", "llm_finish_metrics", "llm_active")
#: How far before a sweep's range groups are looked for that reach into it.
MARGIN_US = 60_000_000
#: Batches from this number on are single writes, numbered by their time; those below are a stream's. Folders put together are negative: -1 - (LEVELS * n + level) has all of lower levels up to n of its kind.
SINGLE = 10**12
LEVELS, FAN = 16, 8
#: Seconds that a folder stays after another has taken its place.
GRACE_S = 600


def level_of(batch: int) -> tuple[int, int]:
    """The level of a folder, and the last batch that it has."""
    return (0, batch) if batch >= 0 else ((-1 - batch) % LEVELS, (-1 - batch) // LEVELS)


class Store:
    """Tables below ``root``, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def refresh(self) -> None:
        """Forgets which files there are, after others have written."""
        self._tables.clear()

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _files(self, path: str) -> tuple[object, object]:
        """The file system of a path, and the path in it."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def exists(self, table: str) -> bool:
        fs, at = self._files(self.path(table))
        return fs.exists(at)

    def _folders(self, table: str) -> Iterator[tuple[str, int, str | None, int]]:
        """Path, day, granularity and batch of each folder; as many as ``compact`` and ``expire`` let there be."""
        depth = "/*" * (3 if table in ROLLED else 2)
        fs, at = self._files(self.path(table) + depth)
        for status in fs.globStatus(at) or ():
            path = status.getPath().toString()
            if m := re.search(r"/day=(-?\d+)(?:/granularity=([^/]+))?/batch=(-?\d+)$", path):
                yield path, int(m[1]), m[2], int(m[3])

    def _mark(self, table: str, day: int, gran: str | None, batch: int) -> str:
        return f"{self.root}/_manifest/{table}/{day}_{gran or 'all'}_{batch}"

    def _marks(self, table: str) -> dict[tuple[int, str | None, int], float]:
        """The folders put together that readers may take, and when they were done (seconds)."""
        fs, at = self._files(f"{self.root}/_manifest/{table}/*")
        out = {}
        for status in fs.globStatus(at) or ():
            day, gran, batch = status.getPath().getName().rsplit("_", 2)
            out[int(day), None if gran == "all" else gran, int(batch)] = status.getModificationTime() / 1000
        return out

    def _dead(self, table: str) -> list[tuple[str, int, str | None, int, float | None]]:
        """Folders whose rows a folder of a higher level has, and since when; also those that were never finished (None)."""
        marks, out = self._marks(table), []
        covers: dict[tuple, list[tuple[int, int, float]]] = {}
        for (day, gran, batch), since in marks.items():
            level, last = level_of(batch)
            covers.setdefault((day, gran, last >= SINGLE), []).append((level, last, since))
        for path, day, gran, batch in self._folders(table):
            level, last = level_of(batch)
            if batch < 0 and (day, gran, batch) not in marks:
                out.append((path, day, gran, batch, None))
            elif by := [since for up, most, since in covers.get((day, gran, last >= SINGLE), ()) if up > level and most >= last]:
                out.append((path, day, gran, batch, min(by)))
        return out

    def _remove(self, path: str) -> None:
        fs, at = self._files(path)
        fs.delete(at, True)

    def _put(self, table: str, rows: DataFrame) -> None:
        """Replaces the folders that ``rows`` (with day and batch) has rows for."""
        keys = ["day", *(["granularity"] if table in ROLLED else [])]
        # REBALANCE lets Spark split a day that is too large for one file
        rows.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys, "batch").parquet(self.path(table))
        self._tables.pop(table, None)

    def write(self, table: str, rows: DataFrame, batch: int | None = None) -> None:
        """Adds rows, by name. Rows of a numbered batch (of a stream) replace those that it wrote before."""
        number = time.time_ns() // 1000 if batch is None else batch
        self._put(table, rows.withColumn("day", F.floor(F.col(TABLES[table]) / DAY_US)).withColumn("batch", F.lit(number).cast("long")))

    def read(self, table: str, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
        """Rows of a table; rollups in all tiers, which are made from the stored rows of all dimensions, and traces with what was patched later."""
        rows = sketches.tiers(self.stored(table, start_us, end_us))
        if table != "traces" or not self.exists("trace_patches"):
            return rows
        if "metadata" not in rows.columns:
            rows = rows.withColumn("metadata", F.lit(None).cast("map<string,string>"))
        return merged_metadata(rows, self.stored("trace_patches", start_us, end_us).select("turn_id", "patch", "seq"))

    def stored(self, table: str, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
        # folders are listed once, not for each question
        rows = self._tables.get(table)
        if rows is None:
            rows = self.spark.read.parquet(self.path(table))
            if dead := self._dead(table):
                # one condition on the folders' names, however many there are
                names = F.concat_ws("/", "day", *(["granularity"] if table in ROLLED else []), "batch")
                rows = rows.where(~names.isin([f"{day}/{gran}/{batch}" if gran else f"{day}/{batch}" for _, day, gran, batch, _ in dead]))
            self._tables[table] = rows
        if start_us is not None:
            rows = rows.where(F.col("day") >= start_us // DAY_US)
        if end_us is not None:
            rows = rows.where(F.col("day") <= end_us // DAY_US)
        return rows.where(predicates.time_range(TABLES[table], start_us, end_us))

    # writes

    def ingest(self, spans: DataFrame, batch: int | None = None) -> None:
        """Spans with their rollups."""
        number = time.time_ns() // 1000 if batch is None else batch
        self.write("spans", spans, number)
        self.ingest_metrics(spans, number)

    def ingest_metrics(self, spans: DataFrame, batch: int | None = None) -> None:
        """The rollups of some spans; rows of windows that are already there add to them, and calls under way go on from the batch before."""
        number = time.time_ns() // 1000 if batch is None else batch

        def active() -> None:
            waiting, own = self.state("pending", number), gauge.steps(spans)
            now, later, clocks = gauge.due(own if waiting is None else own.unionByName(waiting), self.state("clocks", number))
            self.keep("pending", later, number)
            self.keep("clocks", clocks, number)
            self.ingest_active(now, number)

        # three tables that have nothing to do with each other, each some small jobs
        self._at_once(lambda: self.ingest_rollups(sketches.finest(spans), number), lambda: self.write("llm_finish_metrics", metrics.finish_rows(spans), number), active)

    def _at_once(self, *jobs: Callable[[], None]) -> None:
        with ThreadPoolExecutor(len(jobs)) as pool:
            for done in [pool.submit(inheritable_thread_target(job)) for job in jobs]:
                done.result()

    def ingest_rollups(self, finest: DataFrame, batch: int) -> None:
        """Rollup rows of the finest windows, and those of longer ones from them."""
        self.write("llm_metrics", finest, batch)
        # the finest rows come from the files just written, so their spans are read once
        rows = self.spark.read.schema(finest.withColumns({"day": F.lit(0).cast("long"), "batch": F.lit(0).cast("long")}).schema).parquet(self.path("llm_metrics"))
        own = rows.where((F.col("batch") == batch) & (F.col("granularity") == sketches.FINEST)).drop("day", "batch")
        self.write("llm_metrics", sketches.coarser(own), batch)

    def ingest_active(self, steps: DataFrame, batch: int) -> None:
        """Calls under way at the starts among ``steps``, counted on from the batch before."""
        held = iter(("steps", "samples"))

        def hold(rows: DataFrame) -> DataFrame:
            name = next(held)
            self.keep(name, rows, batch)
            return self.spark.read.schema(rows.schema).parquet(self.state_path(name, batch))

        counted, after = gauge.run(steps, self.state("active", batch), hold=hold)
        self.write("llm_active", counted, batch)
        self.keep("active", after, batch)

    # what a batch leaves for the next one; a batch that is done again starts from the same state

    def _states(self, name: str, batch: int) -> list[tuple[int, str]]:
        fs, at = self._files(f"{self.root}/_state/{name}/{'single' if batch >= SINGLE else 'stream'}/*")
        return sorted((int(s.getPath().getName()), s.getPath().toString()) for s in fs.globStatus(at) or ())

    def state(self, name: str, batch: int | None = None, before: bool = True) -> DataFrame | None:
        """What the last batch before this one left; with ``before`` off, what the last one of a stream left."""
        found = [path for number, path in self._states(name, batch or 0) if not before or number < (batch or 0)]
        return self.spark.read.parquet(found[-1]) if found else None

    def state_path(self, name: str, batch: int) -> str:
        return f"{self.root}/_state/{name}/{'single' if batch >= SINGLE else 'stream'}/{batch}"

    def keep(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(self.state_path(name, batch))
        # the one before is needed if the batch is done again
        for _, path in [x for x in self._states(name, batch) if x[0] < batch][:-1]:
            self._remove(path)

    def backfill_metrics(self) -> bool:
        """Makes the rollups from the spans if there are none; tells whether it did."""
        if self.exists("llm_metrics") and self.read("llm_metrics").limit(1).count():
            return False
        self.ingest_metrics(self.read("spans").drop("day", "batch"))
        return True

    def sweep_proxies(self, now_us: int, lookback_us: int = 1_800_000_000, batch: int | None = None) -> int:
        """Tells the turns of the last while that are one call seen more than once, by patches of their metadata; how many it patched.

        All turns of that while are grouped anew, so a leg that comes late joins a group that is there; only what changes is written, so a
        sweep done again writes nothing. Groups that began before are left as they are.
        """
        since = now_us - lookback_us
        rows = self.read("traces", since - MARGIN_US, now_us + 1)
        if "metadata" not in rows.columns:
            rows = rows.withColumn("metadata", F.lit(None).cast("map<string,string>"))
        number = time.time_ns() // 1000 if batch is None else batch
        self.keep("sweep", proxy.patches(rows, since), number)
        changed = self.spark.read.parquet(self.state_path("sweep", number))
        n = changed.count()
        if n:
            self.write("trace_patches", changed.withColumn("seq", F.lit(number).cast("long")), number)
        return n

    # upkeep

    def _live(self, table: str, days: set[int] | None = None) -> dict[tuple, list[tuple[str, int]]]:
        """Path and batch of the folders that readers take, by day, granularity and kind."""
        dead, out = {f[0] for f in self._dead(table)}, {}
        for path, day, gran, batch in self._folders(table):
            if path not in dead and (days is None or day in days):
                out.setdefault((day, gran, level_of(batch)[1] >= SINGLE), []).append((path, batch))
        return out

    def _join(self, table: str, day: int, gran: str | None, batches: list[int], level: int) -> None:
        """Writes the rows of some folders as one of ``level``, then its mark."""
        code = -1 - (LEVELS * max(level_of(b)[1] for b in batches) + min(level, LEVELS - 1))
        rows = self.stored(table).where((F.col("day") == day) & F.col("batch").isin(batches))
        rows = rows if gran is None else rows.where(F.col("granularity") == gran)
        self._put(table, rows.withColumn("batch", F.lit(code).cast("long")))
        fs, at = self._files(self._mark(table, day, gran, code))
        fs.create(at, True).close()
        self._tables.pop(table, None)

    def _sweep(self, table: str, grace_s: float, days: set[int] | None = None) -> int:
        """Deletes folders that others have stood for long enough."""
        gone, now = 0, time.time()
        for path, day, gran, batch, since in self._dead(table):
            if since is not None and now - since >= grace_s and (days is None or day in days):
                self._remove(path)
                gone += 1
                if batch < 0:
                    self._remove(self._mark(table, day, gran, batch))
        self._tables.pop(table, None)
        return gone

    def tidy(self, table: str, days: set[int] | None = None, fan: int = FAN, grace_s: float = GRACE_S) -> int:
        """Puts each ``fan`` folders of a level together, of some days or all; the number of folders that were written. One writer at a time."""
        made = 0
        for (day, gran, _), folders in self._live(table, days).items():
            levels: dict[int, list[int]] = {}
            for _, batch in folders:
                levels.setdefault(level_of(batch)[0], []).append(batch)
            for level in range(LEVELS - 2):
                own = levels.get(level, [])
                if len(own) >= fan:
                    last = max(level_of(b)[1] for b in own)
                    # lower ones up to the last are stood for, too, so they come along
                    own = own + [b for low in range(level) for b in levels.get(low, []) if level_of(b)[1] <= last]
                    self._join(table, day, gran, own, level + 1)
                    made += 1
                    levels = {k: [b for b in v if b not in own] for k, v in levels.items()}
                    levels.setdefault(level + 1, []).append(-1 - (LEVELS * last + level + 1))
        self._sweep(table, grace_s, days)
        return made

    def compact(self, table: str, before_day: int | None = None, least: int = 2) -> int:
        """Puts the folders of each day (before a day, if named) together where there are ``least`` or more of a kind; the number of folders that went.

        One writer at a time: a batch that a stream does again later, with a number that is already compacted, adds nothing.
        """
        for (day, gran, _), folders in self._live(table).items():
            if len(folders) >= least and (before_day is None or day < before_day):
                batches = [b for _, b in folders]
                self._join(table, day, gran, batches, 1 + max(level_of(b)[0] for b in batches))
        return self._sweep(table, 0)

    def expire(self, now_us: int, days: dict[str, int] = RETENTION_DAYS) -> dict[str, int]:
        """Deletes what is older than its table, or granularity, is kept, and tells how many folders went from each table.

        Folders of days before the limit go as they are; where rows grow old by another time than their day's (traces by their end), those
        that are still young stay.
        """
        gone: dict[str, int] = {}
        for table in TABLES:
            if not self.exists(table):
                continue
            for path, day, gran, batch in list(self._folders(table)):
                keep = days.get(gran if table in ROLLED else table, 0)
                limit = now_us - keep * DAY_US
                if not keep or (day + 1) * DAY_US > limit:
                    continue
                if table in AGES:
                    own = self.stored(table).where((F.col("day") == day) & (F.col("batch") == batch))
                    young = own.where(F.col(AGES[table]) >= limit)
                    if young.limit(1).count():
                        self._put(table, self._aside(table, young))
                        continue
                self._remove(path)
                self._remove(self._mark(table, day, gran, batch))
                gone[table] = gone.get(table, 0) + 1
            self._tables.pop(table, None)
        return gone

    def _aside(self, table: str, rows: DataFrame) -> DataFrame:
        """``rows`` from a copy, as no folder can be read and replaced at once."""
        path = f"{self.root}/_aside/{table}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    # questions

    def spans_page(self, start_s: int, end_s: int, where: Sequence[Column] = (), sort: str = "request_us", descending: bool = True, page: int = 1, size: int = 50) -> DataFrame:
        rows = self.read("spans", *predicates.check_range(start_s, end_s))
        return listing.page(rows, where, sort, ("request_us", "e2e_latency_ms", "ttft_ms", "status_code", "input_tokens", "output_tokens"), "id", descending, page, min(size, 200))

    def span(self, span_id: str) -> DataFrame:
        return listing.lookup(self.read("spans"), "id", span_id)

    def traces_page(self, start_s: int, end_s: int, where: Sequence[Column] = (), sort: str = "start_us", descending: bool = True, page: int = 1, size: int = 50) -> DataFrame:
        rows = self.read("traces", *predicates.check_range(start_s, end_s))
        return listing.page(rows, where, sort, ("start_us", "end_us", "duration_ms", "call_count"), "turn_id", descending, page, min(size, 200))

    def live_traces(self, start_s: int, end_s: int, page: int = 1, size: int = 50) -> DataFrame:
        """A page of turns with those under way (``streaming.tracker``) before those written."""
        start, end = predicates.check_range(start_s, end_s)
        from .streaming import tracker  # which writes by this store

        snapshot, rows = tracker.snapshot(self), self.read("traces", start, end).drop("day", "batch") if self.exists("traces") else None
        if snapshot is None and rows is None:
            raise ValueError("no turns are stored or under way")
        going = None if snapshot is None else turns.under_way(snapshot, start, end)
        both = turns.union_in_progress(going.limit(0) if rows is None else rows, rows.limit(0) if going is None else going)
        return both.orderBy(F.col("in_progress").desc(), F.col("start_us").desc(), "turn_id").offset((page - 1) * min(size, 200)).limit(min(size, 200))

    def trace_spans(self, turn_id: str, bodies: bool = False) -> DataFrame:
        ids = self.read("traces").where(F.col("turn_id") == turn_id).select(F.col("turn_id").alias("group"), F.explode("span_ids").alias("id"))
        return listing.fetch(self.read("spans"), ids, [c for c in ("request_body", "response_body") if c in self.read("spans").columns], bodies)

    def summary(self, start_s: int, end_s: int, **dims: Sequence[str]) -> DataFrame:
        start, end = predicates.check_range(start_s, end_s)
        return metrics.totals(self.stored("llm_metrics", start, end).where(sketches.cover(start, end) & predicates.dimensions(**dims)))

    def timeseries(self, fields: Sequence[str], granularity: str, start_s: int, end_s: int, group_by: str | None = None, grid: bool = False, **dims: Sequence[str]) -> DataFrame:
        start, end = predicates.check_range(start_s, end_s)
        step = predicates.check_buckets(start_s, end_s, granularity)
        plain = [f for f in fields if f != "active_calls_max"]
        series = metrics.timeseries(self.stored("llm_metrics", start, end), plain or ["call_count"], granularity, start, end, predicates.dimensions(**dims), group_by, sketches.field)
        if len(plain) < len(fields):
            # a maximum does not add up, so each tier has its own
            active = metrics.timeseries(self.read("llm_active", start, end), ["active_calls_max"], granularity, start, end, predicates.tier(**dims, group_by=group_by), group_by)
            keys = ["ts", *([group_by] if group_by else [])]
            series = series.join(active, keys, "left").select(*keys, *fields)
        return metrics.on_grid(series, fields, start_s, end_s, step, group_by) if grid else series

    def models(self, start_s: int, end_s: int, sort: str = "call_count", limit: int = 20) -> DataFrame:
        start, end = predicates.check_range(start_s, end_s)
        return metrics.model_totals(self.stored("llm_metrics", start, end).where(sketches.cover(start, end)), sort, limit, sketches.field)

    def finish_reasons(self, granularity: str, start_s: int, end_s: int) -> DataFrame:
        return metrics.finish_series(self.read("llm_finish_metrics", *predicates.check_range(start_s, end_s)), granularity)

    def services(self, start_s: int, end_s: int, limit: int = 200, exact: bool = False) -> DataFrame:
        rows = services.services(self.read("spans", *predicates.check_range(start_s, end_s)), exact)
        return services.classify(rows).orderBy(F.col("call_count").desc(), "server_ip", "server_port").limit(min(limit, 500))

    def sessions_page(self, cursor: str | None = None, size: int = 50) -> DataFrame:
        keys = ["last_turn_us", "source_id", "session_id"]
        rows = turns.sessions(self.read("traces"))
        if cursor:
            rows = rows.where(listing.after_cursor(keys, listing.decode_cursor(cursor)))
        return rows.orderBy(*(F.col(k).desc() for k in keys)).limit(max(1, min(size, 200)) + 1)


def retained(rows: DataFrame, time: str, now_us: int, days: int) -> DataFrame:
    """Rows that retention keeps; 0 days keep all."""
    return rows.where(F.col(time) >= now_us - days * DAY_US) if days else rows


def merged_metadata(traces: DataFrame, patches: DataFrame) -> DataFrame:
    """Traces with the top-level keys of ``patches`` (turn_id, patch: map) put over their ``metadata`` (map), null taking a key away; patches of unknown turns do nothing."""
    latest = patches.groupBy("turn_id").agg(F.max_by("patch", "seq").alias("patch")) if "seq" in patches.columns else patches
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key("patch", k), F.lit(False)))
    new = F.when(F.col("patch").isNull(), F.col("metadata")).otherwise(F.map_filter(F.map_concat(kept, F.coalesce("patch", F.create_map().cast("map<string,string>"))), lambda _, v: v.isNotNull()))
    return traces.join(latest, "turn_id", "left").withColumn("metadata", new).drop("patch")
