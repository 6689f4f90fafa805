"""Data sets behind one interface: which subjects there are, and samples of those that are wanted."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.sources import mat, signals
from pulseframe.sources.signals import KEYS


class Loader(ABC):
    """A data set. Subclasses become known to loader() by their name."""

    name = ""
    known: dict[str, type[Loader]] = {}

    def __init_subclass__(cls) -> None:
        Loader.known[cls.name] = cls

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @abstractmethod
    def index(self) -> DataFrame:
        """The recordings that there are: subject_id, session_id."""

    @abstractmethod
    def load(self, subjects: list[str] | None = None, sessions: list[str] | None = None) -> DataFrame:
        """Samples (subject_id, session_id, sample_idx, label, repetition, and ch0, ch1, ... one a channel) of those wanted (None: all)."""

    def subjects(self) -> list[str]:
        """Sorted names; one a subject comes to the driver."""
        return [r[0] for r in self.index().select("subject_id").distinct().sort("subject_id").collect()]


def loader(name: str, spark: SparkSession, root: str, **options) -> Loader:
    """The loader of that name; KeyError with the names that there are."""
    if name not in Loader.known:
        raise KeyError(f"{name!r} is none of {sorted(Loader.known)}")
    return Loader.known[name](spark, root, **options)


def by_channel(samples: DataFrame, n: int) -> DataFrame:
    """An array of n channels as columns ch0, ch1, ..."""
    return samples.select(*KEYS, "sample_idx", "label", "repetition", *(F.col("ch")[k].alias(f"ch{k}") for k in range(n)))


class MatrixFiles(Loader):
    """A folder of matrix files, named after subject, day and time; the files of others stay closed."""

    name = "ninapro_db6"

    def __init__(self, spark: SparkSession, root: str, channels: tuple[int, ...] = mat.CHANNELS, label_field: str = "restimulus"):
        super().__init__(spark, root)
        self.channels, self.label_field = tuple(channels), label_field

    def index(self) -> DataFrame:
        return signals.list_recordings(self.spark, self.root).select(*KEYS)

    def load(self, subjects: list[str] | None = None, sessions: list[str] | None = None) -> DataFrame:
        return by_channel(mat.read_recordings(self.spark, self.root, subjects, sessions, self.label_field, self.channels), len(self.channels))


class ParquetSamples(Loader):
    """Samples as Parquet; where they are partitioned by subject and session, others aren't read."""

    name = "parquet"

    def index(self) -> DataFrame:
        return self.spark.read.parquet(self.root).select(*KEYS).distinct()

    def load(self, subjects: list[str] | None = None, sessions: list[str] | None = None) -> DataFrame:
        return signals.load(self.spark.read.parquet(self.root), subjects, sessions)


class Events(Loader):
    """The events table of a folder as two-channel recordings."""

    name = "events"

    def index(self) -> DataFrame:
        return signals.samples_from_events(self.spark, self.root).select(*KEYS).distinct()

    def load(self, subjects: list[str] | None = None, sessions: list[str] | None = None) -> DataFrame:
        return signals.load(signals.samples_from_events(self.spark, self.root), subjects, sessions)
