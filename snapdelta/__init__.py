"""Staged data pipelines and differential, versioned snapshots on Spark."""

from snapdelta.plans.file_flows import backup_files, restore_files, restore_latest_files
from snapdelta.plans.stages import Pipeline, Stage, clean, errors
from snapdelta.plans.steps import query_versions, vacuum
from snapdelta.plans.table_flows import backup_table, restore_latest_table, restore_table
from snapdelta.session import build_session, scratch_dir

__all__ = [
    "Pipeline",
    "Stage",
    "backup_files",
    "backup_table",
    "build_session",
    "clean",
    "errors",
    "query_versions",
    "restore_files",
    "restore_latest_files",
    "restore_latest_table",
    "restore_table",
    "scratch_dir",
    "vacuum",
]
