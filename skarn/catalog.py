"""The registry of indices: a JSON file in the data folder, replaced as a whole at each change."""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import asdict, dataclass, field
from enum import Enum

from skarn.session import Workspace

MAX_NAME = 255


class IndexType(Enum):
    HNSW = "hnsw"
    DISKANN = "diskann"
    IVFPQ = "ivfpq"
    TEXT = "text"
    BTREE = "btree"
    COLLECTION = "collection"


class IndexStatus(Enum):
    CREATING = "creating"
    ACTIVE = "active"
    DROPPED = "dropped"


@dataclass
class HNSWConfig:
    M: int = 16
    ef_construction: int = 100
    max_elements: int = 1_000_000


@dataclass
class DiskANNConfig:
    R_max_degree: int = 64
    L_build: int = 100
    alpha: float = 1.2
    is_dynamic: bool = False


@dataclass
class IVFPQConfig:
    num_clusters: int = 256
    num_subquantizers: int = 8
    retrain_interval: int = 10_000


@dataclass
class TextConfig:
    analyzer: str = "standard"
    k1: float = 1.2
    b: float = 0.75


@dataclass
class BTreeConfig:
    fields: list[str] = field(default_factory=list)
    unique: bool = False


@dataclass
class BuildParams:
    L_build: int = 100
    alpha: float = 1.2
    num_threads: int = 0


@dataclass
class SearchParams:
    L_search: int = 100
    beam_width: int = 4


@dataclass
class IndexConfig:
    dimensions: int = 0
    max_elements: int = 1_000_000
    metric: str = "l2"
    options: dict = field(default_factory=dict)


@dataclass
class IndexInfo:
    index_id: int
    name: str
    type: str
    status: str
    dimensions: int
    max_elements: int
    config: dict
    collection: str | None = None


class IndexHandle:
    """An opened index: its registry entry and the folder of its files."""

    def __init__(self, info: IndexInfo, path: str) -> None:
        self.info, self.path = info, path

    index_id = property(lambda self: self.info.index_id)
    name = property(lambda self: self.info.name)
    type = property(lambda self: IndexType(self.info.type))
    dimensions = property(lambda self: self.info.dimensions)
    max_elements = property(lambda self: self.info.max_elements)
    is_valid = property(lambda self: self.info.status == IndexStatus.ACTIVE.value)

    def global_page_id(self, page: int) -> int:
        return self.info.index_id << 32 | page

    def flush(self) -> None:
        """Nothing to do: files are durable as they are written."""


class IndexCatalog:
    FILE = "catalog.json"
    _current: IndexCatalog | None = None

    def __init__(self, workspace: Workspace) -> None:
        self.workspace = workspace

    @classmethod
    def initialize(cls, workspace: Workspace) -> IndexCatalog:
        cls._current = cls(workspace)
        return cls._current

    @classmethod
    def instance(cls) -> IndexCatalog:
        if cls._current is None:
            raise RuntimeError("the catalog is not initialized")
        return cls._current

    @classmethod
    def is_initialized(cls) -> bool:
        return cls._current is not None

    @classmethod
    def shutdown(cls) -> None:
        cls._current = None

    def data_dir(self) -> str:
        return self.workspace.data_dir

    def _load(self) -> dict:
        try:
            with open(self.workspace.path(self.FILE)) as f:
                return json.load(f)
        except FileNotFoundError:
            return {"next_id": 1, "indices": {}}

    def _save(self, state: dict) -> None:
        at = self.workspace.path(self.FILE)
        with open(at + ".new", "w") as f:
            json.dump(state, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(at + ".new", at)  # readers see the old file or the new one, never a part

    def create_index(self, name: str, type: IndexType | str, config: IndexConfig | None = None, collection: str | None = None) -> IndexHandle:
        if not 1 <= len(name) <= MAX_NAME:
            raise ValueError("Index name must have 1 to 255 characters")
        kind, config, state = IndexType(type), config or IndexConfig(), self._load()
        if name in state["indices"]:
            raise ValueError(f"Index already exists: {name}")
        if kind is IndexType.BTREE and not 1 <= len(config.options.get("fields", [])) <= 3:
            raise ValueError("a composite index has 1 to 3 fields")
        entry = IndexInfo(state["next_id"], name, kind.value, IndexStatus.ACTIVE.value, config.dimensions, config.max_elements, {"metric": config.metric, **config.options}, collection)
        state["next_id"] += 1
        state["indices"][name] = asdict(entry)
        self._save(state)
        return IndexHandle(entry, self.path_of(entry))

    def create_hnsw_index(self, name: str, dimensions: int, max_elements: int = 1_000_000, config: HNSWConfig | None = None) -> IndexHandle:
        return self.create_index(name, IndexType.HNSW, IndexConfig(dimensions, max_elements, options=asdict(config or HNSWConfig())))

    def create_diskann_index(self, name: str, dimensions: int, max_elements: int = 1_000_000, config: DiskANNConfig | None = None) -> IndexHandle:
        return self.create_index(name, IndexType.DISKANN, IndexConfig(dimensions, max_elements, options=asdict(config or DiskANNConfig())))

    def create_text_index(self, name: str, config: TextConfig | None = None) -> IndexHandle:
        return self.create_index(name, IndexType.TEXT, IndexConfig(options=asdict(config or TextConfig())))

    def create_btree_index(self, name: str, fields: list[str], unique: bool = False) -> IndexHandle:
        return self.create_index(name, IndexType.BTREE, IndexConfig(options={"fields": list(fields), "unique": unique}))

    def path_of(self, info: IndexInfo) -> str:
        return self.workspace.path("indices", str(info.index_id))

    def index_exists(self, name: str) -> bool:
        return name in self._load()["indices"]

    def get_index_info(self, name: str) -> IndexInfo:
        state = self._load()
        if name not in state["indices"]:
            raise KeyError(f"Index not found: {name}")
        return IndexInfo(**state["indices"][name])

    def open_index(self, name: str) -> IndexHandle:
        info = self.get_index_info(name)
        return IndexHandle(info, self.path_of(info))

    def list_indexes(self, collection: str | None = None) -> list[IndexInfo]:
        found = [IndexInfo(**e) for e in self._load()["indices"].values()]
        return [i for i in sorted(found, key=lambda i: i.index_id) if collection is None or i.collection == collection]

    def update_config(self, name: str, **options: object) -> None:
        state = self._load()
        if name not in state["indices"]:
            raise KeyError(f"Index not found: {name}")
        state["indices"][name]["config"].update(options)
        self._save(state)

    def drop_index(self, name: str) -> None:
        state = self._load()
        if name not in state["indices"]:
            raise KeyError(f"Index not found: {name}")
        entry = IndexInfo(**state["indices"].pop(name))
        self._save(state)
        shutil.rmtree(self.path_of(entry), ignore_errors=True)

    def as_dataframe(self):
        rows = [(i.index_id, i.name, i.type, i.status, i.dimensions, i.max_elements, json.dumps(i.config, sort_keys=True), i.collection) for i in self.list_indexes()]
        return self.workspace.spark.createDataFrame(rows, "index_id long, name string, type string, status string, dimensions int, max_elements long, config string, collection string")
