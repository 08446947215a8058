"""The teacher: trajectories that see the targets, a question at a time; and its notes on whole texts.

A step retrieves, gates, probes, proposes notes, selects by the value of each candidate's next
state, writes the state, and ends what is done (`teaching`). A question ends as terminal (a probe
holds, or the state closes the question), or is given up as stalled,
repeated_false_stop_no_progress, empty_candidate_pool or max_steps. No model is asked: a probe's
answer comes from the context, notes are made by rule, and what needs a judge isn't supported.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import strings as S
from . import teacher, teaching

UNIT = "struct<unit:string,chunk:string,doc:string,text:string>"
#: What is read of a question.
READ = {
    "question": "string", "answer": "string", "targets": "array<struct<chunk:string,doc:string,text:string,role:string,weight:double>>", "pool": f"array<{UNIT}>", "chunks": "array<struct<chunk:string,doc:string,text:string>>", "seeds": "array<string>",
}
#: What is told of a step.
TOLD = {
    "t": "int", "unit": "string", "is_note": "boolean", "gain": "double", "found": "array<string>", "kept": "array<string>", "made": "int", "faults": "array<string>", "stop_candidate": "boolean", "proposed": "boolean", "subtype": "string", "goal": "string",
    "ratio": "double", "delta": "int", "covered": "int", "progress": "int", "false_stops": "int", "probe": "struct<answer:string,correct:boolean,sufficient:boolean,stop:boolean>", "notebook": "string", "status": "string", "terminal_t": "int", "reason": "string",
}
#: Questions whose rows a task makes before it hands them on.
BLOCK = 256


def run(questions: DataFrame, most_steps: int = teacher.MAX_STEPS) -> DataFrame:
    """A row for every step, and one for a question that ends without: the trajectories of questions (qid, question, answer, targets, pool, chunks, seeds).

    Seeds are units read before the first step. A question whose first state closes it is
    terminal at step 0. Null lists are empty; a null question or answer counts as empty. Columns:
    qid, t, unit (taken), is_note, gain (its score), found, kept (notes), made (harvest), faults,
    stop_candidate, proposed, subtype, goal, ratio, delta, covered, progress, false_stops, probe,
    notebook (after the step), status, terminal_t and reason (null while it goes on).
    """
    named = lambda c, *names: F.transform(c, lambda x: F.struct(*(x[n].alias(n) for n in names)))
    shaped = {"targets": named("targets", "chunk", "doc", "text", "role", "weight"), "pool": named("pool", "unit", "chunk", "doc", "text"), "chunks": named("chunks", "chunk", "doc", "text")}
    rows = questions.select("qid", *(shaped.get(c, F.col(c)).cast(kind).alias(c) for c, kind in READ.items()))
    schema = f"qid {questions.schema['qid'].dataType.simpleString()}, {', '.join(f'{c} {kind}' for c, kind in TOLD.items())}"
    told = to_arrow_schema(StructType.fromDDL(schema))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield pa.RecordBatch.from_pylist([r for q in batch.slice(at, BLOCK).to_pylist() for r in teaching.taught(q, most_steps)], told)

    return rows.mapInArrow(steps, schema)


def notes_of_texts(texts: DataFrame) -> DataFrame:
    """(id, type, text, sources) of the note that the sentences of each whole text give: (id, name, text, question, answer, repair).

    A sentence is a unit of the document ``name``, numbered from 0. A text is gone through a
    sentence at a time, so that a task holds what it needs of one text.
    """
    schema = f"id {texts.schema['id'].dataType.simpleString()}, type string, text string, sources array<string>"
    told = to_arrow_schema(StructType.fromDDL(schema))

    def note(r: dict) -> dict | None:
        of = lambda i: f"{r['name']}::{i}" if r["name"] is not None else str(i)
        made = teaching.rule_note(r["question"] or "", r["answer"] or "", [(of(i), r["name"], s) for i, s in enumerate(S.sentences(r["text"] or ""))], bool(r["repair"]))
        return made and dict(zip(("id", "type", "text", "sources"), (r["id"], *made)))

    def notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield pa.RecordBatch.from_pylist([n for n in map(note, batch.slice(at, BLOCK).to_pylist()) if n], told)

    return texts.select("id", "name", "text", "question", "answer", "repair").mapInArrow(notes, schema)
