"""Schemas of the tables that the engine reads and makes."""

from pyspark.sql import types as T

S, L, D, B, I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: One scored round. A field that the input lacks has its zero value.
ROUND = _struct(
    id=S, epoch_id=L, intent_id=S, miner_slug=S, rank=L, score=D, question=S, ground_truth=S, miner_answer=S, converted_answer=S, failure_reason=S, scored_at=S
)
ENVELOPE = _struct(scores=T.ArrayType(ROUND), total=L, limit=L, offset=L)
REGISTRY = _struct(
    RegistrationID=I, AuthorAddress=S, WasmURL=S, WasmHash=S, ActivationStatus=S, IntentID=S, BondAmount=D, RejectionReason=S, EvalErrorCount=I, RegisteredAt=S, UpdatedAt=S
)
#: A number or an identifier in a text; start and end are bytes of its UTF-8 form.
NUMBER = _struct(value=D, percent=B, currency=B, start=I, end=I)
IDENT = _struct(kind=S, text=S, start=I, end=I)
#: A correction; coverages are null where nothing was checked.
CORRECTION = _struct(total=T.FloatType(), numeric=T.FloatType(), ident=T.FloatType(), refusal=T.FloatType(), gt_refused=B, numeric_coverage=T.FloatType(), ident_coverage=T.FloatType())
#: Scores of one scorer; error is set where a row failed, and score is null there. batch and seq: the order of writing.
SCORES = _struct(model_hash=S, id=S, score=D, error=S, batch=L, seq=L)
#: What the detectors see in a pair: figures that the answer states differently, of those with a counterpart; identifiers found, of those asked for.
DETECTED = _struct(against=I, checked=I, hits=I, asked=I)
