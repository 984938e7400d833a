"""The engine behind one folder: verticals that are ingested, indexed, searched, exported and counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skald.functions.text import host_of
from skald.operators import index, results, search
from skald.sources import store

VERTICALS = ("web", "images", "videos", "news", "transport")
#: Kinds of search that give constant rows, and what each of those rows has.
STUBS = ("forums", "books", "map", "finance")
ROW = "title string, url string, snippet string, source string"
DOCUMENT = "id string, title string, url string, snippet string, body string, headings string, source string, date string, lang string, meta map<string,string>"
SAVE_SECONDS = 30


@dataclass
class Answer:
    """A page of results, the number of all of them after diversification, and the counts of sources and (on the page) languages."""

    results: DataFrame
    total: int
    sources: DataFrame | None = None
    languages: DataFrame | None = None


class Engine:
    """Documents lie under ``path/<vertical>/v=<n>``, immutable; a table of versions names the last one.

    ``constants`` gives the rows of the empty query and unknown kinds (``default``) and of ``STUBS``
    as lists of (title, url, snippet, source)."""

    def __init__(self, spark: SparkSession, path: str, settings: search.Settings | None = None, constants: dict[str, list[tuple]] | None = None) -> None:
        self.spark, self.path, self.settings, self.constants = spark, path.rstrip("/"), settings or search.Settings(), constants or {}
        self.versions: dict[str, int] = {}
        self.dirty: set[str] = set()
        self.indexes: dict[str, index.Index] = {}
        if self._has(f"{self.path}/versions"):
            rows = spark.read.schema("vertical string, version int").parquet(f"{self.path}/versions")
            self.versions = {r.vertical: r.version for r in rows.groupBy("vertical").agg(F.max("version").alias("version")).collect()}
            self.dirty = set(self.versions)

    def _has(self, path: str) -> bool:
        from pyspark.errors import AnalysisException

        try:
            self.spark.read.parquet(path).schema  # noqa: B018
        except AnalysisException:
            return False
        return True

    def _vertical(self, vertical: str) -> str:
        if vertical not in VERTICALS:
            raise ValueError(f"unknown vertical {vertical!r}")
        return vertical

    def documents(self, vertical: str = "web") -> DataFrame:
        version = self.versions.get(self._vertical(vertical))
        schema = self.spark.createDataFrame([], DOCUMENT).schema
        return self.spark.createDataFrame([], schema) if version is None else self.spark.read.schema(schema).parquet(f"{self.path}/{vertical}/v={version}")

    def _replace(self, vertical: str, docs: DataFrame) -> None:
        version = self.versions.get(vertical, 0) + 1
        docs.write.mode("overwrite").parquet(f"{self.path}/{vertical}/v={version}")
        self.spark.createDataFrame([(vertical, version)], "vertical string, version int").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        self.versions[vertical] = version
        self.dirty.add(vertical)

    def ingest(self, docs: DataFrame | str, vertical: str = "web", mode: str = "append") -> int:
        """Add documents (a table, or the path of a JSON payload) or, with ``replace``, take them instead of all; their number.

        The last document of each id stays; columns that are missing are empty."""
        self._vertical(vertical)
        if mode not in ("append", "replace"):
            raise ValueError(f"unknown mode {mode!r}")
        rows = store.read_payload(self.spark, docs) if isinstance(docs, str) else docs
        names = [f.name for f in self.spark.createDataFrame([], DOCUMENT).schema]
        own = {c.lower() for c in rows.columns}
        full = rows.select(*((F.coalesce(F.col(n).cast("string"), F.lit("")) if n in own else F.lit("")).alias(n) for n in names[:-1]), (F.col("meta") if "meta" in own else F.lit(None)).cast("map<string,string>").alias("meta"))
        new = full.withColumn("seq", F.monotonically_increasing_id())
        old = self.documents(vertical) if mode == "append" else self.documents(vertical).limit(0)
        count = new.count()
        self._replace(vertical, index.upsert(old, new))
        return count

    def seed(self, rows: list[tuple]) -> int:
        """Add (id, title, url, snippet, source) to the web vertical."""
        return self.ingest(self.spark.createDataFrame(rows, "id string, title string, url string, snippet string, source string"))

    def remove(self, vertical: str = "web", source: str | None = None, host: str | None = None) -> int:
        """Remove documents of a source and, or, a host (all without either); their number."""
        docs = self.documents(vertical)
        before = docs.count()
        self._replace(vertical, index.clear_by(docs, source, host, host_of))
        return before - self.documents(vertical).count()

    def export(self, path: str, vertical: str = "web") -> None:
        """One JSON array under ``path``."""
        store.export_json(self.documents(vertical), path, array=True)

    def stats(self, vertical: str = "web") -> Answer:
        docs = self.documents(vertical)
        return Answer(self.list(vertical), docs.count(), search.facet(docs, "source"))

    def list(self, vertical: str = "web", offset: int = 0, limit: int = 50) -> DataFrame:
        return self.documents(vertical).orderBy("id").offset(max(0, offset)).limit(limit if limit > 0 else 50)

    def flush(self) -> list[str]:
        """Store the indexes of verticals that have changed; their names."""
        done = sorted(self.dirty)
        for v in done:
            self.indexes[v] = index.Index.store(self.documents(v), f"{self.path}/{v}/index-{self.versions[v]}")
            self.dirty.discard(v)
        return done

    def autosave(self, seconds: int = SAVE_SECONDS) -> StreamingQuery:
        """Flush changed verticals every ``seconds`` until the returned query is stopped."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda _, __: self.flush() and None).trigger(processingTime=f"{seconds} seconds").start()

    def _index(self, vertical: str) -> index.Index:
        if vertical in self.dirty or vertical not in self.indexes:
            self.dirty.add(vertical)
            if vertical not in self.versions:
                self._replace(vertical, self.documents(vertical))
            self.flush()
        return self.indexes[vertical]

    def _rows(self, kind: str) -> Answer:
        rows = self.spark.createDataFrame(self.constants.get(kind, []), ROW)
        return Answer(rows.select("title", "url", "snippet", F.col("snippet").alias("snippetHtml"), F.col("snippet").alias("snippetPlain"), "source"), rows.count())

    def search(self, q: str, kind: str = "all", sort: str = "relevance", page: int = 1, source: str = "", lang: str = "", from_: str = "", to: str = "", depart: str = "", return_: str = "") -> Answer:
        """A page of one kind of results; ``all`` falls back to news where the web has nothing."""
        q, kind = q.strip(), kind.strip().lower() or "all"
        if not q or kind not in {"all", *VERTICALS} - {"web"}:
            return self._rows(kind if q and kind in STUBS else "default")
        vertical = "web" if kind == "all" else kind
        answer = self._found(vertical, kind, q, sort, page, source, lang if kind == "all" else "", from_, to, depart, return_)
        if kind == "all" and not answer.total:
            fallback = self._found("news", "news", q, sort, page, source, "", from_, to, "", "")
            return Answer(fallback.results, fallback.total, fallback.sources, answer.languages)
        return answer

    def _found(self, vertical: str, kind: str, q: str, sort: str, page: int, source: str, lang: str, from_: str, to: str, depart: str, return_: str) -> Answer:
        docs = self.documents(vertical)
        found = search.search(docs, q, self.settings, self._index(vertical))
        if vertical == "transport":
            kept = search.filtered(found, meta={"from": from_, "to": to, "depart": depart, "return": return_})
        else:
            kept = search.filtered(found, source, lang, from_, to)
        spread = search.diversified(kept, self.settings.per_source, sort)
        shown = results.results(kept, kind, q, page, sort, self.settings.per_source, docs)
        languages = search.language_facet(search.page_of(spread, page, results.SIZES.get(kind, search.PAGE), sort)) if kind == "all" else None
        return Answer(shown, spread.count(), search.facet(kept, "source"), languages)

    def set_synonyms(self, synonyms: dict[str, list[str]]) -> None:
        self.settings.synonyms = synonyms

    def set_priors(self, priors: dict[str, float]) -> None:
        self.settings.priors = priors

