"""A case on any file system: Parquet tables in numbered versions, and a manifest that names the ones that count.

A change writes a new version and then the manifest, so readers see the old state or the new one. Versions that
nobody names are left until ``vacuum``. One writer at a time; the audit log is appended on the driver, as each row
holds the hash of the one before.
"""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.operators import case as ops

# The tables of a case.
SCHEMAS = {
    "evidence": "id long, path string, label string, format string, size long, stored_md5 string, stored_sha1 string, verified_md5 string, verified_sha1 string, verified_at string, kind string, added_at string",
    "bookmarks": "id long, evidence_id long, offset long, length long, label string, note string, tags array<string>, source string, category string, colour string, in_report boolean, created_at string, examiner string",
    "tagged_items": "id long, evidence_id long, part long, node string, path string, name string, size long, is_dir boolean, deleted boolean, tag string, note string, created_at string, examiner string",
    "audit": "seq long, at string, examiner string, action string, detail string, prev_hash string, hash string",
    "saved_searches": "id long, evidence_id long, name string, query string, part long, hit_count long, created_at string, examiner string",
    "search_hits": "search_id long, node string, name string, path string, term string, context string, position long",
    "file_hashes": "evidence_id long, part long, node string, path string, name string, size long, deleted boolean, md5 string, sha1 string, sha256 string, fuzzy string, read_bytes long, computed_at string",
    "artefacts": "evidence_id long, part long, kind string, parser_version int, ran_at string, examiner string, bytes long, payload string",
    "attack_tags": "evidence_id long, part long, target_kind string, target_ref string, technique string, technique_name string, tactic string, note string, asserted boolean, created_at string, examiner string",
    "hash_sets": "id long, name string, kind string, source string, imported_at string, examiner string, entries long",
    "hash_entries": "set_id long, algo string, digest string, label string",
    "type_mismatches": "evidence_id long, part long, node string, path string, name string, size long, extension string, detected string, severity string, found_at string",
}
KEYS = {
    "tagged_items": ["evidence_id", "part", "node", "tag"], "file_hashes": ["evidence_id", "part", "node"], "artefacts": ["evidence_id", "part", "kind"],
    "attack_tags": ["evidence_id", "part", "target_kind", "target_ref", "technique"], "type_mismatches": ["evidence_id", "part", "node", "name"], "evidence": ["id"], "bookmarks": ["id"],
}
#: What a second write of the same key changes; all else stays as first written.
REFRESHED = {
    "tagged_items": ["note"], "file_hashes": ["md5", "sha1", "sha256", "fuzzy", "read_bytes", "computed_at"], "artefacts": ["parser_version", "ran_at", "examiner", "bytes", "payload"],
    "attack_tags": ["technique_name", "tactic", "note", "asserted"], "evidence": ["verified_md5", "verified_sha1", "verified_at"], "bookmarks": ["label", "note", "tags", "category", "colour", "in_report"],
}
MOST_PAYLOAD = 64 << 20


class Case:
    def __init__(self, spark: SparkSession, path: str, examiner: str | None = None):
        self.spark, self.path, self.examiner = spark, path.rstrip("/"), examiner
        self.files, self.root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        self.root = self.root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, name: str, examiner: str | None = None) -> Case:
        case = cls(spark, path, examiner)
        case.files.create_dir(case.root, recursive=True)
        if case.is_case():
            raise FileExistsError(f"{path} is a case")
        case._write({"meta": {"name": name, "created_at": _now()}, "tables": {}, "next": 1})
        case.log("case created", {"name": name})
        return case

    def is_case(self) -> bool:
        return self.files.get_file_info(f"{self.root}/_manifest.json").type == fs.FileType.File

    def _manifest(self) -> dict:
        if not self.is_case():
            raise FileNotFoundError(f"{self.path} is not a case")
        with self.files.open_input_stream(f"{self.root}/_manifest.json") as file:
            return json.loads(file.read())

    def _write(self, manifest: dict) -> None:
        with self.files.open_output_stream(f"{self.root}/_manifest.json.new") as file:
            file.write(json.dumps(manifest).encode())
        self.files.move(f"{self.root}/_manifest.json.new", f"{self.root}/_manifest.json")

    def table(self, name: str) -> DataFrame:
        """The rows that count; columns that older versions lack are null."""
        found = self._manifest()["tables"].get(name)
        if not found:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.path}/{name}/v{n}" for n in found])

    def _put(self, name: str, df: DataFrame, append: bool) -> None:
        manifest = self._manifest()
        version = manifest["next"]
        columns = self.spark.createDataFrame([], SCHEMAS[name])
        columns.unionByName(df.select(*[c for c in df.columns if c in columns.columns]), allowMissingColumns=True).write.parquet(f"{self.path}/{name}/v{version}")
        manifest["tables"][name] = [*(manifest["tables"].get(name, []) if append else []), version]
        manifest["next"] = version + 1
        self._write(manifest)

    def append(self, name: str, df: DataFrame) -> None:
        self._put(name, df, True)

    def upsert(self, name: str, df: DataFrame) -> None:
        own = self.table(name)
        changes = own.limit(0).unionByName(df, allowMissingColumns=True)
        self._put(name, ops.upsert(own, changes, KEYS[name], REFRESHED.get(name, [])), False)

    def replace(self, name: str, df: DataFrame, keys: list[str]) -> None:
        own = self.table(name)
        self._put(name, ops.replace_groups(own, own.limit(0).unionByName(df, allowMissingColumns=True), keys), False)

    def remove(self, name: str, where: str) -> None:
        self._put(name, self.table(name).where(f"NOT coalesce({where}, false)"), False)

    def log(self, action: str, detail: dict | None = None) -> str:
        """Appends to the audit chain; gives the new hash."""
        last = self.table("audit").orderBy(F.desc("seq")).limit(1).collect()
        seq, before = (last[0].seq + 1, last[0].hash) if last else (1, "")
        text, at = json.dumps(detail, sort_keys=True) if detail else None, _now()
        parts = [before, *("None" if x is None else str(x) for x in (seq, at, self.examiner, action, text))]
        digest = hashlib.sha256("|".join(parts).encode()).hexdigest()
        self.append("audit", self.spark.createDataFrame([(seq, at, self.examiner, action, text, before, digest)], SCHEMAS["audit"]))
        return digest

    def verify_audit(self) -> tuple[bool, int | None]:
        row = ops.audit_verify(self.table("audit").withColumn("chain", F.lit(0)), ["chain"]).first()
        return (True, None) if row is None else (row.ok, row.broken_at)

    def save_artefact(self, evidence_id: int, part: int, kind: str, version: int, payload: str) -> None:
        if len(payload.encode()) > MOST_PAYLOAD:
            raise ValueError("a payload is larger than a case keeps")
        row = (evidence_id, part, kind, version, _now(), self.examiner, len(payload.encode()), payload)
        self.upsert("artefacts", self.spark.createDataFrame([row], SCHEMAS["artefacts"]))

    def artefacts(self, versions: dict[str, int]) -> DataFrame:
        """Stored results of the parsers' present versions; those of older ones are left out."""
        wanted = F.lit(False)
        for kind, version in versions.items():
            wanted |= (F.col("kind") == kind) & (F.col("parser_version") == version)
        return self.table("artefacts").where(wanted)

    def remove_evidence(self, evidence_id: int) -> None:
        for name, schema in SCHEMAS.items():
            if name == "evidence" or "evidence_id" in schema:
                if name in self._manifest()["tables"]:
                    self.remove(name, f"{'id' if name == 'evidence' else 'evidence_id'} = {int(evidence_id)}")
        self.log("evidence removed", {"id": evidence_id})

    def holdings(self, evidence_id: int) -> dict[str, int]:
        out = {}
        for name in self._manifest()["tables"]:
            if "evidence_id" in SCHEMAS[name] and (n := self.table(name).where(F.col("evidence_id") == evidence_id).count()):
                out[name] = n
        return out

    def vacuum(self) -> int:
        """Deletes versions that the manifest doesn't name."""
        manifest, gone = self._manifest(), 0
        for name in SCHEMAS:
            kept = {f"v{n}" for n in manifest["tables"].get(name, [])}
            for info in self.files.get_file_info(fs.FileSelector(f"{self.root}/{name}", allow_not_found=True)):
                if info.base_name not in kept:
                    self.files.delete_dir(info.path)
                    gone += 1
        return gone


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
