"""A vector collection: documents, vectors and metadata as Parquet, one folder per
dataset, and a settings record beside them.

Settings have versions. A writer prepares its data beside the others', then claims the version after the one it
read by a rename that fails if that version is there already. Who comes second reads the newer settings and
does its work again on top of them, so datasets that are ingested at the same time are all kept and no id comes twice.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import documents, sqltext
from corpuslab.functions.vectors import metric_of
from corpuslab.operators import embed as emb
from corpuslab.operators import nearest as nn

SETTINGS_SCHEMA = (
    "collection_name string, rag_dataset_paths array<string>, datasets array<string>, "
    "embedding_method string, similarity_method string, used_embedding_fields string, folders array<string>"
)


def collection_name(method: str, similarity: str, fields: str, datasets: list[str]) -> str:
    return "_".join([method, similarity, fields, *datasets])


class VectorCollection:
    """Created or loaded by the class methods; all data stays in files."""

    def __init__(self, spark: SparkSession, root: str, settings: dict, encoder=None):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings
        self.encoder = encoder or settings["embedding_method"]
        self.version = 0
        self.metric = metric_of(settings["similarity_method"])

    @property
    def folder(self) -> str:
        return f"{self.root}/{self.settings['collection_name']}"

    @classmethod
    def create(
        cls, spark: SparkSession, root: str, name: str, method: str = "default", similarity: str = "EUCLIDEAN",
        fields: str = "FULL", encoder=None,
    ) -> "VectorCollection":
        """A new, empty collection. One of the same name is replaced."""
        documents.document(fields)
        if encoder is None and method not in emb.ENCODERS:
            raise ValueError(f"embedding method {method!r} not supported")
        settings = {
            "collection_name": name, "rag_dataset_paths": [], "datasets": [], "folders": [],
            "embedding_method": method, "similarity_method": similarity, "used_embedding_fields": fields,
        }
        made = cls(spark, root, settings, encoder)
        while True:
            try:
                made.version = cls.load(spark, root, name, encoder).version
            except FileNotFoundError:
                pass
            if made._commit(settings):
                return made

    @classmethod
    def load(cls, spark: SparkSession, root: str, name: str, encoder=None) -> "VectorCollection":
        """Newest settings of an existing collection; a missing one is an error."""
        folder = f"{root.rstrip('/')}/{name}/settings"
        try:
            row = spark.read.schema(f"{SETTINGS_SCHEMA}, version int").json(folder).orderBy(F.desc("version")).first()
        except Exception as error:  # noqa: BLE001
            raise FileNotFoundError(f"no collection settings at {folder}") from error
        if row is None:
            raise FileNotFoundError(f"no collection settings at {folder}")
        settings = {k: v for k, v in row.asDict().items() if k != "version"}
        if settings["folders"] is None:  # written before folders had names of their own
            settings["folders"] = [md5(p.encode()).hexdigest() for p in settings["rag_dataset_paths"]]
        held = cls(spark, root, settings, encoder)
        held.version = row["version"]
        return held

    def _refresh(self) -> None:
        newest = VectorCollection.load(self.spark, self.root, self.settings["collection_name"], self.encoder)
        self.settings, self.version = newest.settings, newest.version

    def _store(self, path: str):
        """The Hadoop path and its file system."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _commit(self, settings: dict) -> bool:
        """Make `settings` the next version; False if another writer did so first. A version is written
        elsewhere and takes its name in one step, so readers see whole ones only."""
        waiting = f"{self.folder}/waiting/{uuid4().hex}"
        self.spark.createDataFrame([settings], SETTINGS_SCHEMA).coalesce(1).write.json(waiting)
        source, store = self._store(waiting)
        target, _ = self._store(f"{self.folder}/settings/version={self.version + 1}")
        store.mkdirs(target.getParent())
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(store.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            context.rename(store.makeQualified(source), store.makeQualified(target), plain)
        except Exception:  # noqa: BLE001  there already, or the store failed
            store.delete(source, True)
            if store.exists(target):
                return False
            raise
        self.settings, self.version = settings, self.version + 1
        return True

    def rows(self) -> DataFrame:
        """All documents of the datasets in the settings. A folder that a broken ingest
        left behind is not listed there and not read."""
        folders = [f"{self.folder}/data/{f}" for f in self.settings["folders"]]
        if not folders:
            raise ValueError("the collection is empty")
        return self.spark.read.parquet(*folders)

    def _add(self, path: str, dataset: str, made: Callable[[], DataFrame]) -> bool:
        """Write the rows that `made` gives for the settings as they are, and list them; again if these have changed."""
        while True:
            self._refresh()
            if path in self.settings["rag_dataset_paths"]:
                return False
            folder = f"{md5(path.encode()).hexdigest()}-{uuid4().hex}"
            made().withColumn("dataset", F.lit(dataset)).write.parquet(f"{self.folder}/data/{folder}")
            more = {"rag_dataset_paths": path, "datasets": dataset, "folders": folder}
            if self._commit(self.settings | {k: [*self.settings[k], v] for k, v in more.items()}):
                return True
            at, store = self._store(f"{self.folder}/data/{folder}")
            store.delete(at, True)

    def insert(self, samples: DataFrame, path: str, dataset: str, order: str | None = None) -> bool:
        """Embed and add a dataset known by its path; False if it is already there.

        samples: id, difficulty_type [, domain] and the columns of the chosen fields.
        Ids that the collection holds already are left out; of equal ids in `samples` the
        last counts, by the column `order` if it is named, else by the values of the row.
        Several writers may insert at the same time; a broken try leaves nothing that is read.
        """
        text = documents.document(self.settings["used_embedding_fields"])
        domain = F.coalesce("domain", F.lit("")) if "domain" in samples.columns else F.lit("")
        flags = [c.alias(f"tag_{n}") for n, c in sqltext.tag_flags(F.col("difficulty_type")).items()]
        place = F.col(order).alias("_place") if order else F.lit(0).alias("_place")
        new = samples.select("id", place, text.alias("document"), domain.alias("domain"), *flags)
        values = F.struct(*[c for c in new.columns if c != "id"])
        new = new.groupBy("id").agg(F.max(values).alias("v")).select("id", "v.*").drop("_place")

        def made() -> DataFrame:
            fresh = new.join(self.rows().select("id"), "id", "left_anti") if self.settings["folders"] else new
            return emb.embed(fresh, "document", self.encoder)

        return self._add(path, dataset, made)

    def add_rows(self, rows: DataFrame, path: str, dataset: str) -> bool:
        """As `insert`, for rows that carry their own id, document, vec and metadata."""
        return self._add(path, dataset, lambda: rows)

    def query(self, queries: DataFrame, n_results: int, where=None) -> DataFrame:
        """Nearest documents (query_id, doc_id, distance, rank, document) for queries with
        vectors; `where` is a condition on the metadata."""
        held = self.rows() if where is None else self.rows().where(where)
        found = nn.nearest(queries, held.select(F.col("id").alias("doc_id"), "vec"), n_results, self.metric)
        return found.join(held.select(F.col("id").alias("doc_id"), "document"), "doc_id")
