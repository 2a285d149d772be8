"""Ready queries over the given tables, and the SQL that each must agree with."""

from __future__ import annotations

from banterscope.plans import audio, chat, training
from banterscope.plans import sql_audio, sql_chat, sql_training

QUERIES = {**chat.QUERIES, **audio.QUERIES, **training.QUERIES}
SQL = {**sql_chat.SQL, **sql_audio.SQL, **sql_training.SQL}

__all__ = ["QUERIES", "SQL"]
