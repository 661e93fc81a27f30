"""Hash-chained records: sealing, parallel verification, signatures, erasure and redaction, decision records."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import materialised

GENESIS = "0" * 64
# The key of a tombstone, and the fields of a record that name a subject.
TOMBSTONE, SUBJECT_FIELDS = "tombstone", ("project", "merge_request")


def canonical(payload: str) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(json.loads(payload), sort_keys=True, separators=(",", ":"))


def record_digest(previous: str, sequence: int, payload: str, algorithm: str = "blake2b") -> str:
    """The digest of the previous digest, the sequence and the canonical payload, a line each: 256 bits of BLAKE2b, or ``sha256``."""
    text = f"{previous}\n{sequence}\n{canonical(payload)}".encode()
    return hashlib.blake2b(text, digest_size=32).hexdigest() if algorithm == "blake2b" else hashlib.new(algorithm, text).hexdigest()


def _digest_or_none(previous, sequence, payload, algorithm: str) -> str | None:
    try:
        return record_digest(previous, int(sequence), payload, algorithm)
    except (TypeError, ValueError):
        return None


def with_digest(df: DataFrame, previous: str, sequence: str, payload: str, out: str, algorithm: str = "blake2b") -> DataFrame:
    """Adds the digest that a record should have, in Arrow batches; null where the payload is no JSON."""

    @F.pandas_udf("string")
    def made(p: pd.Series, s: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_digest_or_none(*row, algorithm) for row in zip(p, s, b, strict=True)], dtype=object)

    return df.withColumn(out, made(F.col(previous), F.col(sequence), F.col(payload)))


def canonical_json(payload: Column) -> Column:
    @F.pandas_udf("string")
    def made(p: pd.Series) -> pd.Series:
        return p.map(lambda x: None if x is None else canonical(x))

    return made(payload)


def signature(key: bytes, value: str) -> str:
    return hmac.new(key, value.encode(), hashlib.sha256).hexdigest()


def seal(records: DataFrame, chain: str, order: str, payload: str, algorithm: str = "blake2b", signer: tuple[str, bytes] | None = None, after: DataFrame | None = None) -> DataFrame:
    """(chain, order, sequence, previous, digest, signature, key_id, payload): records sealed along each chain.

    Each digest needs the one before, so a chain is read in order inside one task, chains side by side; a task holds one Arrow
    batch and the last digest, however long a chain is. ``after`` (chain, sequence, digest) are the ends of chains that are
    continued. A payload that is no JSON fails the job: it can't be sealed.
    """
    kinds = dict(records.dtypes)
    rows = records.select(F.col(chain).alias("c"), F.col(order).alias("o"), F.col(payload).alias("p"))
    if after is not None:
        rows = rows.join(after.select(F.col(chain).alias("c"), F.col("sequence").alias("n"), F.col("digest").alias("d")), "c", "left")
    else:
        rows = rows.withColumns({"n": F.lit(None).cast("long"), "d": F.lit(None).cast("string")})

    def run(batches):
        held, n, last = object(), 0, GENESIS
        for pdf in batches:
            out = []
            for c, o, p, n0, d0 in zip(pdf["c"], pdf["o"], pdf["p"], pdf["n"], pdf["d"], strict=True):
                if c != held:
                    held, n, last = c, 0 if pd.isna(n0) else int(n0), d0 or GENESIS
                n += 1
                digest = record_digest(last, n, p, algorithm)
                out.append((c, o, n, last, digest, signature(signer[1], digest) if signer else "", signer[0] if signer else "", p))
                last = digest
            yield pd.DataFrame(out, columns=["c", "o", "sequence", "previous", "digest", "signature", "key_id", "payload"])

    schema = f"c {kinds[chain]}, o {kinds[order]}, sequence long, previous string, digest string, signature string, key_id string, payload string"
    sealed = rows.repartition("c").sortWithinPartitions("c", "o").mapInPandas(run, schema)
    return sealed.withColumnsRenamed({"c": chain, "o": order})


def checked(entries: DataFrame, chain: str, position: str, algorithm: str = "blake2b", keys: dict[str, bytes] | None = None) -> DataFrame:
    """Adds place, accepted and reason (null, link, sequence, digest, signature) to every record. Each record is checked against
    its own predecessor only, so a chain is verified in parallel."""
    order = Window.partitionBy(chain).orderBy(position)
    placed = with_digest(check_signatures(entries, keys), "previous", "sequence", "payload", "__right", algorithm)
    placed = placed.withColumns({"place": F.row_number().over(order), "__before": F.lag("digest", 1, GENESIS).over(order)})
    reason = (
        F.when(F.col("previous") != F.col("__before"), "link")
        .when(F.col("sequence") != F.col("place"), "sequence")
        .when(~F.col("digest").eqNullSafe(F.col("__right")), "digest")
        .when(~F.coalesce("accepted", F.lit(True)), "signature")
    )
    return placed.withColumn("reason", reason).drop("__before", "__right")


def verify(entries: DataFrame, chain: str, position: str, expect_at_least: DataFrame | None = None, algorithm: str = "blake2b", keys: dict[str, bytes] | None = None) -> DataFrame:
    """Per chain: n, signed, unheld (key names), status, broken_at and reason of the first record that does not hold.

    tampered: a record does not hold, or the chain is shorter than ``expect_at_least`` (chain, least) says from outside; without
    that, a chain that lost its end still holds. unverifiable: the links hold, but signatures could not be judged: no key of
    that name, or keys are given and a record is unsigned. intact: all else.
    """
    signed = F.coalesce(F.col("signature"), F.lit("")) != ""
    rows = checked(entries, chain, position, algorithm, keys)
    out = rows.groupBy(chain).agg(
        F.count("*").alias("n"),
        F.count_if(signed).alias("signed"),
        F.array_sort(F.collect_set(F.when(signed & F.col("accepted").isNull(), F.col("key_id")))).alias("unheld"),
        F.min(F.when(F.col("reason").isNotNull(), F.struct("place", "reason"))).alias("first"),
    )
    if expect_at_least is not None:
        out = out.join(expect_at_least, chain, "left")
    short = F.coalesce(F.col("n") < F.col("least"), F.lit(False)) if expect_at_least is not None else F.lit(False)
    broken = F.when(F.col("first").isNotNull(), F.col("first.place")).when(short, F.col("n").cast("int"))
    reason = F.coalesce("first.reason", F.when(short, "truncated"))
    open_ = (F.size("unheld") > 0) if keys is None else ((F.size("unheld") > 0) | (F.col("signed") < F.col("n")))
    status = F.when(reason.isNotNull(), "tampered").when(open_, "unverifiable").otherwise("intact")
    return out.select(chain, "n", "signed", "unheld", status.alias("status"), broken.alias("broken_at"), reason.alias("reason"))


def check_signatures(entries: DataFrame, keys: dict[str, bytes] | None) -> DataFrame:
    """Adds accepted: true, false, or null where no key of that name is held or nothing is signed."""
    held = keys or {}
    if "signature" not in entries.columns:
        entries = entries.withColumns({"signature": F.lit(""), "key_id": F.lit("")})

    @F.pandas_udf("boolean")
    def judged(d: pd.Series, s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if not sig or name not in held else hmac.compare_digest(signature(held[name], value or ""), sig) for value, sig, name in zip(d, s, k, strict=True)], dtype=object)

    return entries.withColumn("accepted", judged(F.col("digest"), F.col("signature"), F.col("key_id")))


def is_older(stamp: Column, cutoff: Column) -> Column:
    """Instants are compared; undated records are never older."""
    return F.coalesce(F.try_to_timestamp(stamp) < cutoff, F.lit(False))


def is_tombstone(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, f"$.{TOMBSTONE}").isNotNull(), F.lit(False))


def erase(records: DataFrame, selected: Column, policy: str, when: str, payload: str = "payload") -> DataFrame:
    """Replaces the payload of selected records, but tombstones, by a tombstone; to be sealed again."""
    stone = F.to_json(F.struct(F.struct(F.lit(policy).alias("policy"), F.lit(when).alias("removed_at")).alias(TOMBSTONE)))
    chosen = F.coalesce(selected, F.lit(False)) & ~is_tombstone(F.col(payload))
    return records.withColumn(payload, F.when(chosen, stone).otherwise(F.col(payload)))


def redact(records: DataFrame, selected: Column, policy: str, when: str, fields: tuple[str, ...] = SUBJECT_FIELDS, payload: str = "payload") -> DataFrame:
    """Blanks the fields that name a subject, where a selected record has them, and stamps it; to be sealed again."""

    @F.pandas_udf("string")
    def made(p: pd.Series) -> pd.Series:
        def one(text):
            held = json.loads(text)
            return json.dumps(held | {f: "" for f in fields if f in held} | {"redacted_at": when, "redaction_policy": policy}, sort_keys=True, separators=(",", ":"))

        return p.map(lambda x: None if x is None else one(x))

    chosen = F.coalesce(selected, F.lit(False)) & ~is_tombstone(F.col(payload))
    return records.withColumn(payload, F.when(chosen, made(F.when(chosen, F.col(payload)))).otherwise(F.col(payload)))


def rewrite(entries: DataFrame, chain: str, position: str, change: Callable[[DataFrame], DataFrame], algorithm: str = "blake2b", keys: dict[str, bytes] | None = None, signer: tuple[str, bytes] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, outcome): a store whose records ``change`` has altered, each chain sealed again from its beginning.

    outcome (chain, kept, changed, refused): a chain that does not verify, or is signed and could not be signed again, is left
    as it is and named with the reason; so is one in which nothing changed, without a reason. The store is written once before, as
    it is read several times: entries that are still to be sealed would be sealed anew for each.
    """
    entries = materialised(entries)
    state = verify(entries, chain, position, None, algorithm, keys)
    refused = (
        F.when(F.col("status") == "tampered", F.concat(F.lit("record "), F.col("broken_at").cast("string"), F.lit(": "), "reason"))
        .when((F.col("status") == "unverifiable") & (F.col("signed") > 0), "signatures could not be verified")
        .when((F.col("signed") > 0) & F.lit(signer is None), "no key to sign the rewrite")
    )
    altered = change(entries).select(chain, position, F.col("payload").alias("__new"))
    both = entries.join(altered, [chain, position])
    counts = both.groupBy(chain).agg(F.count("*").alias("kept"), F.count_if(~F.col("payload").eqNullSafe(F.col("__new"))).alias("changed"))
    outcome = materialised(state.join(counts, chain).select(chain, "kept", F.when(refused.isNull(), F.col("changed")).otherwise(0).alias("changed"), refused.alias("refused")))
    rewritten = both.join(outcome.filter("refused is null and changed > 0").select(chain), chain, "left_semi").select(chain, position, F.col("__new").alias("payload"))
    fresh = seal(rewritten, chain, position, "payload", algorithm, signer)
    left = entries.join(outcome.filter("refused is not null or changed = 0").select(chain), chain, "left_semi")
    for column in ("signature", "key_id"):
        if column not in left.columns:
            left = left.withColumn(column, F.lit(""))
    return fresh.unionByName(left.select(*fresh.columns)), outcome


def decisions(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(run, payload): one decision record per run as canonical JSON, to be sealed.

    runs: run, verdict, exit_code, project, merge_request, trace_id, recorded_at. findings: run, rule_id, file_path,
    line_number, producer, blocks, directive (null: not suppressed), reason. Records hold rules and places, never source. A run
    whose failing verdict nothing that may block stands behind is a record that says it is incomplete.
    """
    place = F.concat("file_path", F.lit(":"), F.col("line_number").cast("string"))
    claim = F.struct(place.alias("location"), "producer", "rule_id")
    stands = F.col("directive").isNull()
    held = findings.groupBy("run").agg(
        F.array_sort(F.collect_list(F.when(stands, claim))).alias("findings"),
        F.array_sort(F.collect_list(F.when(stands & F.col("blocks"), claim))).alias("blocking"),
        F.array_sort(F.collect_list(F.when(~stands, F.struct(place.alias("location"), F.coalesce("reason", F.lit("")).alias("reason"), F.col("directive").alias("rule_id"))))).alias("suppressions"),
    )
    rows = runs.join(held, "run", "left")
    none = F.array().cast("array<struct<location:string,producer:string,rule_id:string>>")
    blocking = F.when(F.col("verdict") == "fail", F.coalesce("blocking", none)).otherwise(none)
    complete = (F.col("verdict") != "fail") | (F.size(blocking) > 0)
    body = F.to_json(
        F.struct(
            blocking.alias("blocking"), complete.alias("completed"), "exit_code", F.when(~complete, "a failing verdict needs a finding that may block").otherwise("").alias("failure_reason"),
            F.coalesce("findings", none).alias("findings"), "merge_request", "project", "recorded_at", F.coalesce("suppressions", F.array().cast("array<struct<location:string,reason:string,rule_id:string>>")).alias("suppressions"),
            "trace_id", F.when(complete, F.col("verdict")).otherwise("warn").alias("verdict"),
        )
    )
    return rows.select("run", body.alias("payload"))


def fingerprint(*prompts: Column) -> Column:
    """12 hex digits."""
    return F.substring(F.sha2(F.concat_ws("\n", *prompts).cast("binary"), 256), 1, 12)
