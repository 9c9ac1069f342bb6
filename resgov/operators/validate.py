"""Request validation (approve / revoke) as a column: valid rows and
quarantined rejects come from one pass, first failing rule wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_truthy, stripped_length
from ..functions.times import midnight_as_written
from ..functions.labels import expiry_warning

# Messages of the reference's validation rules.
NAME_AND_ID_REQUIRED = "Resource name and ID are required"
JUSTIFICATION_TOO_SHORT = "Justification must be at least 10 characters"
IDS_REQUIRED = "Resource ID and workspace ID are required"
REASON_TOO_SHORT = "Revocation reason must be at least 10 characters"
INVALID_EXPIRATION = "Invalid expiration date"
UNKNOWN_ACTION = "Unknown action"
MIN_TEXT = 10


def _too_short(text: Column) -> Column:
    return text.isNull() | (stripped_length(text) < MIN_TEXT)


def approval_error(name: Column, resource_id: Column, justification: Column,
                   expiration: Column | None = None) -> Column:
    err = (F.when(~is_truthy(name) | ~is_truthy(resource_id), NAME_AND_ID_REQUIRED)
           .when(_too_short(justification), JUSTIFICATION_TOO_SHORT))
    if expiration is not None:
        err = err.when(is_truthy(expiration) & midnight_as_written(expiration).isNull(), INVALID_EXPIRATION)
    return err


def revoke_error(resource_id: Column, workspace_id: Column, reason: Column) -> Column:
    return (F.when(~is_truthy(resource_id) | ~is_truthy(workspace_id), IDS_REQUIRED)
            .when(_too_short(reason), REASON_TOO_SHORT))


def decision_error(log: DataFrame) -> Column:
    """Error text of a decision-log row, null when it is valid."""
    approve = approval_error(F.col("resource_name"), F.col("resource_id"), F.col("reason"),
                             F.col("expiration_date"))
    revoke = revoke_error(F.col("resource_id"), F.col("workspace_id"), F.col("reason"))
    return (F.when(F.col("action") == "approve", approve)
            .when(F.col("action") == "revoke", revoke)
            .otherwise(F.lit(UNKNOWN_ACTION)))


def with_errors(log: DataFrame) -> DataFrame:
    """The log with its error texts.

    They come out of a generator, through which no filter on them is pushed:
    pushed down, the rules would be evaluated over every expression that the
    columns they name (several times) stand for.  Filters on other columns pass.
    """
    return log.select("*", F.explode(F.array(decision_error(log))).alias("error"))


def valid_decisions(log: DataFrame) -> DataFrame:
    return with_errors(log).filter(F.col("error").isNull()).drop("error")


def rejected_decisions(log: DataFrame) -> DataFrame:
    return with_errors(log).filter(F.col("error").isNotNull())


def validate_approvals(requests: DataFrame):
    """(valid, rejects) for approval requests (justification column)."""
    err = approval_error(F.col("resource_name"), F.col("resource_id"), F.col("justification"),
                         F.col("expiration_date") if "expiration_date" in requests.columns else None)
    tagged = requests.withColumn("error", err)
    return tagged.filter(F.col("error").isNull()).drop("error"), tagged.filter(F.col("error").isNotNull())


def validate_revokes(requests: DataFrame):
    """(valid, rejects) for revocation requests (revoked_reason column)."""
    tagged = requests.withColumn("error", revoke_error(F.col("resource_id"), F.col("workspace_id"),
                                                       F.col("revoked_reason")))
    return tagged.filter(F.col("error").isNull()).drop("error"), tagged.filter(F.col("error").isNotNull())


def expiry_warnings(log: DataFrame, as_of: Column) -> DataFrame:
    """Approvals whose requested expiry lies before the as-of day (a hint, not a reject)."""
    exp = midnight_as_written(F.col("expiration_date"))
    return (valid_decisions(log).filter((F.col("action") == "approve") & exp.isNotNull())
            .select("seq", "resource_id", "workspace_id", exp.alias("expiration_date"),
                    expiry_warning(exp, as_of).alias("past_expiry")))
