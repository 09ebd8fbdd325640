"""Table schemas (as DDL), error codes and configuration of the log engine."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

RECORD = "topic string, partition int, offset long, timestamp long, attributes byte, key binary, value binary"
LOG = "topic string, partition int, offset long, timestamp long, attributes byte, key binary, value binary, encoded_size int, crc32c long, segment_base long, position long"
SEGMENTS = "topic string, partition int, base_offset long, next_offset long, size_bytes long, created_at_ms long, is_active boolean"
INDEX_ENTRIES = "topic string, partition int, base_offset long, relative_offset long, position long"
TOPICS = "name string, num_partitions int, replication_factor short"
BROKERS = "id int, host string, port int"
PARTITIONS = "topic string, partition int, leader int, epoch int, log_start long, leo long, hw long, replicas array<int>, isr array<int>"
REPLICAS = "topic string, partition int, broker_id int, leo long, last_caught_up_ms long, in_sync boolean"
OFFSETS = "group_id string, topic string, partition int, offset long, commit_pos long, commit_ts long"
MEMBERS = "group_id string, member_id string, session_timeout_ms int, last_heartbeat_ms long, metadata binary"
GROUPS = "group_id string, state string, generation int, leader_id string, protocol_type string, protocol_name string"
ASSIGNMENTS = "group_id string, member_id string, topic string, partition int"
PENDING_ACKS = "id long, topic string, partition int, required_hw long, deadline_ms long"

# Protocol error codes by name.
ERRORS = {
    "none": 0,
    "unknown": 1,
    "offset_out_of_range": 2,
    "corrupt_message": 3,
    "unknown_topic_or_partition": 4,
    "not_leader_for_partition": 5,
    "request_timed_out": 6,
    "message_too_large": 7,
    "not_enough_replicas": 8,
    "unknown_member_id": 9,
    "rebalance_in_progress": 10,
    "illegal_generation": 11,
    "invalid_group_id": 12,
    "unsupported_version": 13,
    "topic_already_exists": 14,
    "invalid_partition_count": 15,
    "invalid_topic": 17,
}

MIB = 1 << 20
DAY_MS = 86_400_000
#: A record is never larger than this, all fields included.
MAX_RECORD_BYTES = MIB
#: Bytes of a record with neither key nor value.
RECORD_OVERHEAD = 33
INDEX_ENTRY_BYTES = 8


def index_max_bytes(segment_bytes: int, interval_bytes: int) -> int:
    """Room for twice the index entries of a full segment, from 64 KiB to 10 MiB."""
    if interval_bytes <= 0:
        return 10 * MIB
    return min(10 * MIB, max(64 << 10, (segment_bytes // interval_bytes + 1) * INDEX_ENTRY_BYTES * 2))


@dataclass
class BrokerConfig:
    id: int = 1
    host: str = "0.0.0.0"
    port: int = 9092
    data_dir: str = ""
    max_connections: int = 1024
    request_timeout_ms: int = 30_000
    log_level: str = "info"


@dataclass
class LogConfig:
    segment_bytes: int = 128 * MIB
    segment_ms: int = 7 * DAY_MS
    index_interval_bytes: int = 4096
    index_max_bytes: int = 0  # derived from the segment policy if not given
    retention_ms: int = 7 * DAY_MS
    retention_bytes: int = -1
    flush_ms: int = 1000
    flush_messages: int = 0
    max_message_bytes: int = MIB

    def __post_init__(self):
        if not self.index_max_bytes:
            self.index_max_bytes = index_max_bytes(self.segment_bytes, self.index_interval_bytes)


@dataclass
class TopicConfig:
    auto_create: bool = False
    default_partitions: int = 3
    default_replication_factor: int = 1


@dataclass
class ReplicationConfig:
    replica_lag_time_max_ms: int = 30_000
    replica_fetch_max_bytes: int = MIB
    replica_fetch_wait_max_ms: int = 500
    min_insync_replicas: int = 1


@dataclass
class GroupConfig:
    session_timeout_ms: int = 45_000
    heartbeat_interval_ms: int = 3000
    rebalance_timeout_ms: int = 60_000
    offsets_topic_partitions: int = 50


@dataclass
class Config:
    broker: BrokerConfig = field(default_factory=BrokerConfig)
    log: LogConfig = field(default_factory=LogConfig)
    topic: TopicConfig = field(default_factory=TopicConfig)
    replication: ReplicationConfig = field(default_factory=ReplicationConfig)
    group: GroupConfig = field(default_factory=GroupConfig)

    def validate(self) -> Config:
        if self.log.segment_bytes > 0xFFFFFFFF:
            raise ValueError("segment_bytes must fit 32 bits: index positions do")
        if self.broker.request_timeout_ms <= 0:
            raise ValueError("request_timeout_ms must be positive")
        return self

    @classmethod
    def from_text(cls, text: str) -> Config:
        """From the text of a settings file: sections, and in them ``name: value`` lines, as YAML writes two levels of plain values."""
        values: dict = {}
        section: dict = {}
        for line in text.splitlines():
            line = re.sub(r"(^|\s)#.*", "", line).rstrip()
            if not line:
                continue
            name, colon, value = (x.strip() for x in line.partition(":"))
            if not colon:
                raise ValueError(f"no setting: {line!r}")
            if not line[0].isspace():
                section = values.setdefault(name, {})
                if value:
                    raise ValueError(f"a section has no value of its own: {line!r}")
            else:
                value = value.strip("\"'")
                section[name] = {"true": True, "false": False}.get(value, int(value) if re.fullmatch(r"-?[0-9]+", value) else value)
        return cls.from_dict({k: v for k, v in values.items() if k in cls.__dataclass_fields__})

    @classmethod
    def load(cls, spark, path: str) -> Config:
        """From a settings file on any store that Spark reaches."""
        return cls.from_text(spark.read.option("wholetext", True).text(path).first()[0])

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        """From nested settings, as a YAML or JSON file gives them; zero and empty settings mean the default."""
        kinds = {"broker": BrokerConfig, "log": LogConfig, "topic": TopicConfig, "replication": ReplicationConfig, "group": GroupConfig}
        parts = {k: kind(**{n: v for n, v in (values.get(k) or {}).items() if v not in (0, "", None)}) for k, kind in kinds.items()}
        return cls(**parts).validate()
