"""The chain of stages over a folder of tables by day: each run reads and writes only what lies behind the runs before.

Windows, anomalies and alerts carry on from the positions of the last finished run and look back only as far as baselines and open
alerts reach. Duplicates and incidents are folded anew from the last moment at which no alert was near any other across it. Every
stage replaces its table's content from some moment on, so a run that fails is made good by the next, and a run repeated under its
number counts once: its number is added to the table of finished runs at the end.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..operators import alerts as al
from ..operators import detect, incidents
from ..operators import windows as win
from ..sources.days import DAY, DayTable, LogStore
from ..sources.stages import stored

#: Stages in their order, and the shorter runs: windows alone, or all behind them.
STAGES = ("windows", "anomalies", "positions", "alerts", "duplicates", "incidents")
AGGREGATE, PROCESS = STAGES[:1], STAGES[1:]
#: Time by which a stage's table is cut into days.
_TIME = {"windows": "window_start", "anomalies": "window_start", "alerts": "start", "duplicates": "start", "incidents": "start"}
_RUNS = "number bigint, stage string, path string, schema string, since bigint"
_KEY = ["service", "size"]


class Chain:
    """most: windows that a run closes at most for each service and size, so that one after a long pause stays bounded."""

    def __init__(self, spark: SparkSession, base: str, cfg: Config, adjacent: set[tuple[str, str]], most: int | None = None):
        self.spark, self.base, self.cfg, self.adjacent, self.most = spark, base.rstrip("/"), cfg, adjacent, most

    def _runs(self) -> DataFrame:
        """Finished runs, one row per run and stage."""
        try:
            return self.spark.read.schema(_RUNS).parquet(f"{self.base}/runs")
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], _RUNS)
            raise

    def _newest(self) -> dict:
        """The newest row of each stage; the driver sees one row per stage, however many runs there were."""
        newest = self._runs().groupBy("stage").agg(F.max(F.struct("number", "stage", "path", "schema", "since")).alias("row"))
        return {r.row.stage: r.row for r in newest.collect()}

    def _open(self, row) -> DataFrame | DayTable | None:
        if row is None:
            return None
        schema = T.StructType.fromJson(json.loads(row.schema))
        return DayTable(self.spark, row.path, schema, _TIME[row.stage]) if row.stage in _TIME else self.spark.read.schema(schema).parquet(row.path)

    def tables(self) -> dict[str, DataFrame | None]:
        newest = self._newest()
        opened = {s: self._open(newest.get(s)) for s in STAGES}
        return {s: t.read() if isinstance(t, DayTable) else t for s, t in opened.items()}

    def table(self, stage: str) -> DataFrame | None:
        """A stage's table; None before its first finished run."""
        return self.tables()[stage]

    def write(self, batch: DataFrame, number: int) -> None:
        """A micro-batch of logs: kept under its number, so that a repeated one isn't kept twice; then all stages if it closed any window."""
        store = LogStore(self.spark, f"{self.base}/logs", batch.schema)
        store.append(batch, number)
        self.run(store, number=number)

    def run(self, logs: DataFrame | LogStore | None = None, stages: tuple[str, ...] = STAGES, number: int | None = None) -> dict[str, DataFrame]:
        """Runs the stages named; logs: all so far (a store is read by days), needed for windows and duplicates only. anomalies goes with positions.

        The stages behind windows are left out if windows was run and none was closed. Stages left out are read as they are.
        """
        unknown = set(stages) - set(STAGES)
        if unknown:
            raise ValueError(f"unknown stage {', '.join(sorted(unknown))}")
        if number is not None and self._runs().where(F.col("number") == number).take(1):
            return self.tables()
        newest = self._newest()
        run = _Run(self, logs, newest, number if number is not None else max((r.number for r in newest.values()), default=-1) + 1)
        for stage in (s for s in STAGES if s in stages):
            if getattr(run, stage)() == 0 and stage == "windows":
                break
        self.spark.createDataFrame(run.done, _RUNS).coalesce(1).write.mode("append").parquet(f"{self.base}/runs")
        return self.tables()


class _Run:
    """One run: its stages read what finished runs and its own earlier stages left."""

    def __init__(self, chain: Chain, logs: DataFrame | LogStore | None, newest: dict, number: int):
        self.chain, self.spark, self.cfg, self.logs, self.newest, self.number = chain, chain.spark, chain.cfg, logs, newest, number
        # A number used again after a failure writes small tables to other folders than the failed run.
        self.home, self.done = f"{chain.base}/{number}-{uuid.uuid4().hex[:8]}", [(number, "run", "", "", None)]

    def _table(self, stage: str) -> DataFrame | DayTable | None:
        """As this run has left it so far, or else the last finished one."""
        own = [r for r in self.done if r[1] == stage]
        return self.chain._open(T.Row("number", "stage", "path", "schema", "since")(*own[-1]) if own else self.newest.get(stage))

    def _since(self, stage: str, behind: str | None = None) -> int | None:
        """The earliest moment noted by runs of `stage`, or by those since `behind` was run last; None if there is none."""
        last = self.newest.get(behind)
        rows = self.chain._runs().where(F.col("stage") == stage)
        rows = rows if last is None else rows.where(F.col("number") > last.number)
        noted = [rows.agg(F.min("since")).first()[0], *(r[4] for r in self.done if r[1] == stage)]
        return min((s for s in noted if s is not None), default=None)

    def _note(self, stage: str, path: str, schema: T.StructType, since: int | None = None) -> None:
        self.done.append((self.number, stage, path, schema.json(), since))

    def _small(self, name: str, rows: DataFrame) -> None:
        path = f"{self.home}/{name}"
        rows.write.mode("overwrite").parquet(path)
        self._note(name, path, rows.schema)

    def _replace(self, stage: str, rows: DataFrame, since: int | None) -> None:
        table = DayTable(self.spark, f"{self.chain.base}/{stage}", rows.schema, _TIME[stage])
        table.replace(rows, since)
        self._note(stage, table.path, rows.schema)

    def _logs(self, start: int | None) -> DataFrame:
        if isinstance(self.logs, LogStore):
            return self.logs.read(start)
        return self.logs if start is None else self.logs.where(F.col("ts") >= start)

    def windows(self) -> int:
        """New windows of services whose logs reach behind their last window by one and the grace; returns their number.

        closed holds, for each service and size, where its windows end so far (null before the first) and the span of logs seen.
        """
        old, before, sizes = self._table("windows"), self._table("closed"), F.explode(F.array(*(F.lit(w).cast("bigint") for w in self.cfg.windows)))
        # What is new comes with the newest batch of a store; other logs are passed over once for their services' spans.
        new = self.logs.read(batch=self.number) if isinstance(self.logs, LogStore) else self.logs
        seen = new.groupBy("service").agg(F.min("ts").alias("low"), F.max("ts").alias("high")).select("service", sizes.alias("size"), F.lit(None).cast("bigint").alias("since"), "low", "high")
        seen = seen if before is None else seen.unionByName(before)
        seen = stored(seen.groupBy(_KEY).agg(F.max("since").alias("since"), F.min("low").alias("low"), F.max("high").alias("high")))
        begin = F.coalesce(F.col("since"), F.col("low") - F.pmod("low", F.col("size")))
        start = seen.where(F.col("high") - self.cfg.grace >= begin + F.col("size")).agg(F.min(begin)).first()[0]
        if start is None:
            self._small("closed", seen)
            return 0
        made = win.metric_windows(self._logs(start), self.cfg, since=seen.select(*_KEY, "since"), most=self.chain.most)
        made = stored(made)
        first, n = made.agg(F.min("window_start"), F.count("*")).first()
        kept = made if old is None else old.read(first).join(seen, _KEY, "left").where("window_start < since").select(made.columns).unionByName(made)
        self._replace("windows", kept, None if old is None else first)
        ends = made.groupBy(_KEY).agg(F.max(F.col("window_start") + F.col("size")).alias("until"))
        self._small("closed", seen.join(ends, _KEY, "left").select(*_KEY, F.coalesce("until", "since").alias("since"), "low", "high"))
        return n

    def anomalies(self) -> None:
        """Anomalies of windows behind the positions, which are read with the history that their baselines need."""
        old, closed, done = self._table("anomalies"), self._table("closed"), self._table("positions")
        windows = self._table("windows")
        if done is None:
            made = detect.mad_anomalies(win.baselines(windows.read(), self.cfg), self.cfg)
            return self._replace("anomalies", made, None)
        last = F.col("last_closed_window_start")
        behind = closed.where("since IS NOT NULL").join(done, _KEY, "left").where(last.isNull() | (F.col("since") > last + F.col("size")))
        if behind.where(last.isNull()).take(1):
            back = first = None
        else:
            back, first = behind.agg(F.min(last - self.cfg.baseline_windows * F.col("size")), F.min(last + F.col("size"))).first()
            if first is None:
                return None
        own = windows.read(back).join(behind.select(*_KEY, last), _KEY).where(last.isNull() | (F.col("window_start") > last - self.cfg.baseline_windows * F.col("size")))
        based = win.baselines(own.drop(last), self.cfg).join(done, _KEY, "left").where(last.isNull() | (F.col("window_start") > last))
        made = detect.mad_anomalies(based, self.cfg)
        kept = old.read(first).join(done, _KEY, "left").where(F.col("window_start") <= last).select(made.columns)
        return self._replace("anomalies", kept.unionByName(made), first)

    def positions(self) -> None:
        """The last window per service and size that was looked at for anomalies."""
        self._small("positions", self._table("closed").where("since IS NOT NULL").select(*_KEY, (F.col("since") - F.col("size")).alias("last_closed_window_start")))

    def alerts(self) -> None:
        """Alerts of services and types with new anomalies, folded on from the last alert that those may extend."""
        old, seen, done, anomalies = self._table("alerts"), self._table("alerted"), self._table("positions"), self._table("anomalies")
        last, key = F.col("last_closed_window_start"), ["service", "anomaly_type"]
        if old is None:
            made = stored(al.debounce(anomalies.read(), self.cfg))
            self._replace("alerts", made, None)
            self._note("changed", "", T.StructType(), made.agg(F.min("start")).first()[0])
            return self._small("alerted", done)
        before = seen.withColumnRenamed("last_closed_window_start", "seen")
        fresh = done.join(before, _KEY, "left").where(F.col("seen").isNull() | (last > F.col("seen"))).drop(last)
        low = None if fresh.where("seen IS NULL").take(1) else fresh.agg(F.min("seen")).first()[0]
        new = anomalies.read(low).join(fresh, _KEY).where("seen IS NULL OR window_start > seen")
        since = new.groupBy(key).agg(F.min(F.struct("window_start", "id")).alias("from"))
        first = since.agg(F.min("from.window_start")).first()[0]
        self._small("alerted", done)
        if first is None:
            return None
        # An alert lasts at most alert_max, and is extended at most debounce behind its end.
        back = first - self.cfg.debounce - self.cfg.alert_max
        kept = old.read(back)
        opened = F.struct(F.col("start").alias("window_start"), F.substring("alert_id", 3, 10_000).alias("id"))
        reach = kept.join(since, key).where((opened < F.col("from")) & (F.col("end") >= F.col("from.window_start") - self.cfg.debounce))
        cut = since.join(reach.groupBy(key).agg(F.max(opened).alias("open")), key, "left").select(*key, F.coalesce("open", "from").alias("cut"))
        own = anomalies.read(back).join(cut, key).where(F.struct("window_start", "id") >= F.col("cut"))
        made = stored(al.debounce(own.drop("cut"), self.cfg))
        stay = kept.join(cut, key, "left").where(F.col("cut").isNull() | (opened < F.col("cut"))).select(made.columns)
        changed = made.join(kept, made.columns, "left_anti").agg(F.min("start")).first()[0]
        self._replace("alerts", stay.unionByName(made), back)
        return self._note("changed", "", T.StructType(), changed)

    def _quiet(self, at: int) -> int | None:
        """The first start behind the last moment up to `at` that no two alerts come near each other across; None: there is none.

        Alerts are looked through backwards, in spans that double.
        """
        pad, days = max(self.cfg.dedup_same, self.cfg.dedup_trace, self.cfg.proximity), 2
        alerts = self._table("alerts")
        oldest = self._since("changed")
        while True:
            low = at - days * DAY
            bucket = F.floor(F.col("start") / pad)
            per = alerts.read(low).groupBy(bucket.alias("bucket")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
            w = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
            # A gap of more than pad never lies inside a bucket.
            per = per.withColumn("reach", F.max(F.col("end") + pad).over(w))
            found = per.where(F.col("reach").isNotNull() & (F.col("start") > F.col("reach")) & (F.col("start") <= at)).agg(F.max("start")).first()[0]
            if found is not None:
                return found
            if low <= oldest:
                return None
            days *= 2

    def duplicates(self) -> None:
        """Duplicates from the last quiet moment before the first alert that changed."""
        changed, first = self._since("changed", "duplicates"), "duplicates" not in self.newest
        if changed is None and not first:
            return None
        since = None if first else self._quiet(changed)
        own = self._table("alerts").read(since)
        pairs = al.duplicates(own, al.same_service_edges(own, self.cfg).unionByName(al.shared_trace_edges(own, self._logs(since), self.cfg)), self.cfg)
        starts = own.select(F.col("alert_id").alias("duplicate"), "start")
        self._replace("duplicates", pairs.join(starts, "duplicate").select("canonical", "duplicate", "reason", "start"), since)
        return self._note("refolded", "", T.StructType(), since if since is not None else own.agg(F.min("start")).first()[0])

    def incidents(self) -> None:
        """Incidents from where duplicates were folded anew."""
        since, first = self._since("refolded", "incidents"), "incidents" not in self.newest
        if since is None and not first:
            return None
        since = None if first else since
        made = incidents.cluster(self._table("alerts").read(since), self._table("duplicates").read(since).drop("start"), self.chain.adjacent, self.cfg)
        return self._replace("incidents", made, since)
