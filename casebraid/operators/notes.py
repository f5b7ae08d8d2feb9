"""Notes, their visibility, replies and mentions (FLT-02, FLT-06..08, AGG-32, SET-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alive(rows: DataFrame, deleted: bool = False) -> DataFrame:
    """FLT-02: rows that are not marked as deleted, or those that are."""
    return rows.where(F.col("deletado_em").isNotNull() if deleted else F.col("deletado_em").isNull())


def visible(notes: DataFrame, mentions: DataFrame, members: DataFrame, user: Column) -> DataFrame:
    """FLT-06: the notes that a user sees: global ones, own or mentioning personal ones, those of the user's teams.

    Both lists are filtered to the user first and meet the notes by their keys, each once.
    """
    named = mentions.where(F.col("usuario") == user).select("note_id", F.lit(True).alias("__named")).distinct()
    teams = members.where(F.col("usuario") == user).select("equipe", F.lit(True).alias("__member")).distinct()
    flagged = notes.join(named, "note_id", "left").join(teams, "equipe", "left")
    personal = (F.col("escopo") == "pessoal") & ((F.col("autor") == user) | F.col("__named").isNotNull())
    team = (F.col("escopo") == "equipe") & F.col("__member").isNotNull()
    return flagged.where((F.col("escopo") == "global") | personal | team).drop("__named", "__member")


def threads(notes: DataFrame) -> DataFrame:
    """FLT-07: notes without a parent, each with its replies (note_id, autor) in order."""
    replies = notes.where("parent_id is not null").groupBy(F.col("parent_id").alias("note_id")).agg(F.array_sort(F.collect_list(F.struct("note_id", "autor"))).alias("respostas"))
    return notes.where("parent_id is null").join(replies, "note_id", "left").withColumn("respostas", F.coalesce("respostas", F.array().cast("array<struct<note_id:bigint,autor:bigint>>")))


def unread(mentions: DataFrame, notes: DataFrame) -> DataFrame:
    """AGG-32: usuario, n: mentions not yet seen, in notes that are not deleted and of another author."""
    open_ = mentions.where(~F.col("visto")).join(alive(notes).select("note_id", "autor"), "note_id")
    return open_.where("usuario <> autor").groupBy("usuario").agg(F.count("*").alias("n"))


def mention_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """SET-05: note_id, usuario, change (insert or delete) that turn one set of mentions into another."""
    keys = ["note_id", "usuario"]
    new = after.select(*keys).distinct().join(before.select(*keys), keys, "left_anti").withColumn("change", F.lit("insert"))
    old = before.select(*keys).distinct().join(after.select(*keys), keys, "left_anti").withColumn("change", F.lit("delete"))
    return new.unionByName(old)
