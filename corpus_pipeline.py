"""The corpus pipeline: toxic documents go, repeated lines go, one document of
each near-duplicate group stays, contaminated documents go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet in the shared folder and read again as the next stage's input.
"""

from __future__ import annotations

from factweave.llm.pipeline import STAGES, drop_contaminated, drop_near_duplicates, drop_repeated_lines, drop_toxic, pack_windows, run

__all__ = ["ORACLE_SQL", "STAGES", "drop_contaminated", "drop_near_duplicates", "drop_repeated_lines", "drop_toxic", "pack_windows", "run"]

#: SQL can't express the fitted chain or the tokenizer; tests use brute force.
ORACLE_SQL = None
