"""Which class a fact belongs to, where an archive holds several of one name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What tells methods apart: an archive may hold a class name twice, at two paths or for several runtime versions.
METHOD_KEY = ["archive_id", "class_id", "owner", "method", "desc"]


def method_key(*facts: DataFrame) -> list[str]:
    """The columns that name a method in all of the tables; ``class_id`` counts where every table has it."""
    return [c for c in METHOD_KEY if all(c in f.columns for f in facts)]


def class_key(*facts: DataFrame) -> list[str]:
    """The same for its class."""
    return [c for c in method_key(*facts) if c in METHOD_KEY[:3]]


def base_members(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of the classes that are not for a certain runtime version; all of them where the tables do not tell."""
    if "class_id" not in members.columns or "class_id" not in classes.columns:
        return members
    return members.join(classes.where(is_base(classes)).select("archive_id", "class_id"), ["archive_id", "class_id"], "left_semi")


def with_class_id(facts: DataFrame, owner: str = "owner") -> DataFrame:
    """``class_id``, the path of the class's entry in its archive; facts without it come from archives that hold a name once."""
    return facts if "class_id" in facts.columns else facts.withColumn("class_id", F.col(owner))


def is_base(classes: DataFrame) -> Column:
    """Classes that are not for a certain runtime version only."""
    return F.coalesce(F.col("runtime_version"), F.lit(0)) == 0 if "runtime_version" in classes.columns else F.lit(True)


def definitions(classes: DataFrame, *columns: str) -> DataFrame:
    """``archive_id, internal_name`` and the given columns of the one class that defines the name for those who refer to it.

    That is the class for the lowest runtime version, the first by path among several.  Combined before the shuffle.
    """
    classes = with_class_id(classes, "internal_name")
    version = F.coalesce(F.col("runtime_version"), F.lit(0)) if "runtime_version" in classes.columns else F.lit(0)
    order = F.struct(version, F.col("class_id"))
    first = classes.groupBy("archive_id", "internal_name").agg(F.min_by(F.struct(*columns), order).alias("first"))
    return first.select("archive_id", "internal_name", "first.*")
