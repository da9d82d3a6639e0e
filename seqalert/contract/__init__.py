"""Queries over the driver's tables and their check SQL."""

from importlib import import_module

for _part in ("sequences", "metrics", "episode_queries", "sampling_queries", "abi_queries", "file_queries", "model_queries", "stream_queries"):
    import_module(f"seqalert.contract.{_part}")
