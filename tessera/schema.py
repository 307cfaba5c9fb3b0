"""Schemas of the stored tables."""

from __future__ import annotations

SAMPLE = "dataset string, idx int, text string"
SCORE = "model string, dataset string, idx long, nll double, tokens long, chars long, bytes long"
#: Keys and types of a run log, under the names they have in its file.
RUN_LOG_FIELDS = {
    "neg_log_prob_sum": "double",
    "avg tokens": "double",
    "avg character count": "double",
    "parameters count": "double",
    "avg bytes": "double",
    "sample_count": "bigint",
    "model_name_or_path": "string",
    "tokenizer_name": "string",
    "data_path": "string",
    "chunk_size": "bigint",
    "add_bos": "boolean",
    "model_args": "map<string,string>",
    "tokenizer_args": "map<string,string>",
    "requirements": "array<string>",
    "batch_size": "bigint",
    "compression_rate": "double",
}
RUN_LOG = ", ".join(f"`{name}` {kind}" for name, kind in RUN_LOG_FIELDS.items())
