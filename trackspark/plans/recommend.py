"""Feature table -> fitted space -> similar songs -> report."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackspark.operators import knn, prep, report, resolve
from trackspark.operators.skew import hot_join
from trackspark.schema import OVERFETCH, RETAINED_VARIANCE
from trackspark.session import materialise
from trackspark.sources import features as tables, models


class Recommender:
    """Similar-song search over one feature table.

    The table stays distributed; the object holds DataFrames and the fitted stages. The
    space is fitted once and used for every search, also after loading it.
    """

    def __init__(
        self,
        table: DataFrame,
        feature_weights: Mapping[str, float] | None = None,
        fill_missing: float | None = None,
    ):
        self.table = prep.clean_key(prep.canonical_columns(table))
        self.feature_columns = prep.feature_columns(self.table)
        self.weights = feature_weights
        self.fill_missing = fill_missing
        self.space: prep.FeatureSpace | None = None
        self.metric = "cosine"
        self.n_neighbors = 5
        self._index: knn.NeighbourIndex | None = None
        self._vectors: DataFrame | None = None

    @classmethod
    def from_path(cls, spark: SparkSession, path: str, **options) -> Recommender:
        return cls(tables.load_features(spark, path), **options)

    # fitting ----------------------------------------------------------------

    def fit(
        self,
        n_neighbors: int = 5,
        metric: str = "cosine",
        n_components: float | int | None = RETAINED_VARIANCE,
    ) -> Recommender:
        if metric not in knn.METRICS:
            raise ValueError(f"unknown metric: {metric}")
        self.space = prep.fit_feature_space(
            self.table, self.feature_columns, self.weights, n_components, self.fill_missing
        )
        self.metric, self.n_neighbors, self._index, self._vectors = metric, n_neighbors, None, None
        return self

    def save_model(self, path: str) -> None:
        models.save_space(self._fitted(), path, self.table.sparkSession, metric=self.metric, n_neighbors=self.n_neighbors)

    def load_model(self, path: str) -> Recommender:
        self.space, settings = models.load_model(path, self.table.sparkSession)
        self.metric, self.n_neighbors = settings["metric"], settings["n_neighbors"]
        self.feature_columns, self._index, self._vectors = list(self.space.columns), None, None
        return self

    def _fitted(self) -> prep.FeatureSpace:
        if self.space is None:
            raise ValueError("fit or load a model first")
        return self.space

    def vectors(self) -> DataFrame:
        """``id`` (the path) and ``vector`` of every song, made once and kept for all searches."""
        if self._vectors is None:
            made = self._fitted().transform(self.table.select("file_path", *self.feature_columns))
            self._vectors = materialise(made.select(F.col("file_path").alias("id"), "vector"))
        return self._vectors

    # searching --------------------------------------------------------------

    def find_similar(
        self,
        song: str,
        n_songs: int | None = None,
        exclude: Iterable[str] | DataFrame | None = None,
        overfetch: int | None = OVERFETCH,
    ) -> DataFrame:
        """Feature rows of the most similar songs with ``similarity_score`` and ``rank``."""
        n = self.n_neighbors if n_songs is None else n_songs
        hit = resolve.resolve_one(self.table, song).head()
        if hit is None:
            raise ValueError(f"Song not found: {song}")
        vectors = self.vectors()
        seed = vectors.where(F.col("id") == hit.file_path).limit(1)
        if exclude is not None and not isinstance(exclude, DataFrame):
            spark = self.table.sparkSession
            exclude = spark.createDataFrame([(p,) for p in exclude], "id string")
        top = knn.similar_to(vectors, seed, n, exclude, overfetch, self.metric)
        picked = F.broadcast(top.select(F.col("id").alias("file_path"), "similarity_score", "rank"))  # n rows
        return self.table.join(picked, "file_path").orderBy("rank")

    def index(self, k_max: int) -> knn.NeighbourIndex:
        if self._index is None or self._index.k_max < k_max:
            self._index = knn.build_index(self.vectors(), k_max, self.metric)
        return self._index

    def find_similar_many(
        self,
        queries: DataFrame,
        n_songs: int | None = None,
        exclusions: DataFrame | None = None,
        overfetch: int = OVERFETCH,
    ) -> DataFrame:
        """Batch form. ``queries``: ``query_id, song_path``; ``exclusions``: ``query_id, file_path``.

        Returns ``query_id, file_path, similarity_score, rank``; queries that resolve to
        nothing have no rows. Songs asked for by many queries are searched once.
        """
        n = self.n_neighbors if n_songs is None else n_songs
        k = n if exclusions is None else n * overfetch
        found = materialise(
            resolve.resolve_songs(queries, self.table).where(F.col("file_path").isNotNull())
        )
        wanted = found.select(F.col("file_path").alias("id")).distinct()
        near = knn.knn_join(self.index(k), self.vectors().join(wanted, "id", "left_semi"), k)
        asked = found.select("query_id", F.col("file_path").alias("_seed"))
        answers = near.withColumnRenamed("query_id", "_seed")
        pairs = hot_join(asked, answers, "_seed", F.col("query_id")).select("query_id", "id", "score", "rank")
        if exclusions is not None:
            gone = exclusions.select("query_id", F.col("file_path").alias("id"))
            pairs = knn.without_excluded(pairs, gone, n, overfetch)
        return pairs.select(
            "query_id", F.col("id").alias("file_path"), F.col("score").alias("similarity_score"), "rank"
        )

    def report(self, song: str, similar: DataFrame) -> DataFrame:
        """Display table: the asked-for song, then the ranked rows."""
        durations = "duration" if "duration" in self.table.columns else "cast(null as double) as duration"
        spark = self.table.sparkSession
        hit = resolve.resolve_one(self.table, song, tiers=(2, 3, 4))
        found = self.table.selectExpr("file_path", durations).join(F.broadcast(hit), "file_path").limit(1)
        asked = spark.createDataFrame([(0, song)], "query_id int, song_path string")
        queries = asked.join(found.withColumn("query_id", F.lit(0)), "query_id", "left")
        return (
            report.similarity_report(queries, similar.withColumn("query_id", F.lit(0)))
            .drop("query_id")
            .orderBy("rank")
        )
