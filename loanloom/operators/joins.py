"""Joins: profile, states to loans, feature assembly, lookups and applicant matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loanloom.functions.scalars import folded, parse_birth_date
from loanloom.operators.latest import latest_score

IDENTITY = ("name", "surname", "date_of_birth")


def fan_out_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join where `left` has one row per key and `right` may hold any number.

    Spark cannot split the right side of a left outer join, so a key with most of the rows would land in
    one task. An inner join has no such limit: adaptive execution splits a heavy key on either side. The
    rows of `left` that match nothing follow from an anti join with the distinct keys, which combine on the
    map side. It is one plan at any size, and no job runs while it is built.
    """
    alone = left.join(right.select(key).distinct(), key, "left_anti")
    return left.join(right, key).unionByName(alone, allowMissingColumns=True)


def left_join_sparse(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on a text key that is NULL in many left rows.

    A hash join sends every NULL to one task. Such a row matches nothing, so its key is replaced by a
    hash of the row, which no right key can equal, and the rows spread out.
    """
    nowhere = F.concat(F.lit("\u0000"), F.xxhash64(*left.columns).cast("string"))
    keyed = left.withColumn("_key", F.coalesce(F.col(key), nowhere))
    return keyed.join(right.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")


def profile(users: DataFrame, questionnaires: DataFrame, user_columns, questionnaire_columns) -> DataFrame:
    """Users with their questionnaire, if any; a user with several has several rows."""
    people = users.select(F.col("id").alias("user_id"), *user_columns)
    return fan_out_left_join(people, questionnaires.select("user_id", *questionnaire_columns), "user_id")


def states_to_loans(states: DataFrame, loans: DataFrame) -> DataFrame:
    """Every loan state with the owner of its loan. AQE splits a heavy loan: the join is inner."""
    return states.join(loans.select(F.col("id").alias("loan_id"), "user_id"), "loan_id")


def assemble(base: DataFrame, *parts: DataFrame, key: str = "user_id") -> DataFrame:
    """Left joins of pre-aggregated parts. All are partitioned by the key, so no part moves twice."""
    return reduce(lambda left, right: left.join(right, key, "left"), parts, base)


def left_join_renaming(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    """Left join where a column present on both sides keeps its name on the left, gets a suffix on the right."""
    clashes = {c: c + suffix for c in right.columns if c != key and c in left.columns}
    return left.join(right.withColumnsRenamed(clashes), key, "left")


def score_lookup(users: DataFrame, scores: DataFrame) -> DataFrame:
    """Users with their latest successful score and grade, NULL where there is none."""
    newest = latest_score(scores, ["akb_score", "akb_grade"], with_count=False)
    return users.join(newest, "user_id", "left")


def customer_record(users: DataFrame, questionnaires: DataFrame, scores: DataFrame, user_ids: DataFrame) -> DataFrame:
    """Birth date and latest score of the customers in `user_ids`: filters first, joins what is left."""
    wanted = users.select(F.col("id").alias("user_id")).join(user_ids.select("user_id").distinct(), "user_id", "left_semi")
    dates = questionnaires.select("user_id", "birth_date").join(user_ids, "user_id", "left_semi")
    return score_lookup(fan_out_left_join(wanted, dates, "user_id"), scores.join(user_ids, "user_id", "left_semi"))


def identity_keys(df: DataFrame) -> list[Column]:
    return [folded(F.col("name")).alias("_name"), folded(F.col("surname")).alias("_surname"),
            F.col("date_of_birth").alias("_birth")]


def existing_applicants(applications: DataFrame, submissions: DataFrame) -> DataFrame:
    """Applications with the id of their earliest earlier submission by the same person, or NULL.

    Submissions shrink to one row per identity first, so no pair of rows is ever formed.
    """
    first = (
        submissions.select(*identity_keys(submissions), "id", "submitted_at")
        .groupBy("_name", "_surname", "_birth")
        .agg(F.min_by("id", F.struct("submitted_at", "id")).alias("existing_id"))
    )
    keys = ["_name", "_surname", "_birth"]
    return applications.select("*", *identity_keys(applications)).join(first, keys, "left").drop(*keys)


def earlier_in_batch(applications: DataFrame, key: str = "application_id") -> DataFrame:
    """Applications with the key of the first one of the same person in this batch, NULL for the first itself.

    First is the smallest time, then the smallest key. An identity with a NULL part equals no other.
    """
    keys = ["_name", "_surname", "_birth"]
    keyed = applications.select("*", *identity_keys(applications))
    first = keyed.dropna(subset=keys).groupBy(*keys).agg(F.min_by(key, F.struct("submitted_at", key)).alias("_first"))
    earlier = F.when(F.col("_first") != F.col(key), F.col("_first")).alias("earlier_application")
    return keyed.join(first, keys, "left").select(*applications.columns, earlier)


def one_birth_date(questionnaires: DataFrame) -> DataFrame:
    """One birth date per user: that of the questionnaire with the smallest id."""
    return questionnaires.groupBy("user_id").agg(F.min_by("birth_date", "id").alias("stored_birth_date"))


def with_birth_date(applications: DataFrame, users: DataFrame, questionnaires: DataFrame) -> DataFrame:
    """Birth date of an existing customer: stored, else as supplied; an error text if neither is there."""
    known = users.select(F.col("id").alias("user_id")).join(one_birth_date(questionnaires), "user_id", "left")
    joined = left_join_sparse(applications, known, "user_id")
    birth = F.coalesce("stored_birth_date", parse_birth_date(F.col("date_of_birth")))
    error = (
        F.when(F.nullif(F.col("user_id"), F.lit("")).isNull(), "User ID is required for existing customers")
        .when(birth.isNull(), "Date of birth required — user not found in database")
    )
    return joined.select("*", birth.alias("birth_date"), error.alias("decision_error")).drop("stored_birth_date")


def first_login_match(users: DataFrame, name: str) -> DataFrame:
    """The smallest user id whose login contains the name, in any case."""
    hits = users.where(folded(F.col("login")).contains(name.lower()))
    return hits.agg(F.min("id").alias("user_id")).where("user_id IS NOT NULL")


def users_by_name(users: DataFrame, names: DataFrame) -> DataFrame:
    """For each of many names the smallest user id whose login contains it.

    A substring test cannot be hashed, so every login is cut into its substrings of the lengths that
    occur among the names. These are reduced to the smallest id on the map side and then matched by
    equality, so a substring most logins share costs one row per task and no pairs are formed.
    """
    wanted = names.select(folded(F.col("name")).alias("_name")).where("_name <> ''").distinct()
    lengths = wanted.select(F.length("_name").alias("_len")).distinct()
    by_length = (
        users.select(F.col("id").alias("user_id"), folded(F.col("login")).alias("_login"))
        .select("user_id", "_login", F.explode(F.sequence(F.lit(1), F.length("_login"))).alias("_len"))
        .join(lengths, "_len", "left_semi")
    )
    starts = F.explode(F.sequence(F.lit(1), F.length("_login") - F.col("_len") + 1))
    pieces = by_length.select("user_id", "_login", "_len", starts.alias("_start")).select(
        "user_id", F.substring("_login", F.col("_start"), F.col("_len")).alias("_name")
    )
    smallest = pieces.groupBy("_name").agg(F.min("user_id").alias("matched_user_id"))
    found = smallest.join(wanted, "_name", "left_semi")
    return left_join_sparse(names.withColumn("_name", folded(F.col("name"))), found, "_name").drop("_name")


def login_postings(users: DataFrame, length: int = 3) -> DataFrame:
    """The index of logins: gram, user_id and login for every distinct piece of 1 to `length` letters of a login.

    A login of n letters has at most `length` x n rows. Written once, it serves any number of lookups.
    """
    logins = users.select(F.col("id").alias("user_id"), folded(F.col("login")).alias("login")).where("login <> ''")
    pieces = F.expr(f"flatten(transform(sequence(1, {length}), k -> filter(transform(sequence(1, length(login)), "
                    f"i -> substring(login, i, k)), p -> length(p) = k)))")
    return logins.select(F.explode(F.array_distinct(pieces)).alias("gram"), "user_id", "login")


def users_by_index(postings: DataFrame, names: DataFrame, length: int = 3) -> DataFrame:
    """For each of many names the smallest user id whose login contains it, by an index of logins.

    A name of up to `length` letters is a gram itself, whose smallest id is an aggregate. A longer name takes the
    rarest of its grams, and only the logins with that gram are tried for the whole name.
    """
    per_gram = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("logins"), F.min("user_id").alias("matched_user_id"))
    wanted = names.select(folded(F.col("name")).alias("_name")).where("_name <> ''").distinct()
    short = wanted.where(F.length("_name") <= length).join(
        per_gram.withColumnRenamed("gram", "_name"), "_name").select("_name", "matched_user_id")
    grams = F.expr(f"transform(sequence(1, length(_name) - {length} + 1), i -> substring(_name, i, {length}))")
    tried = wanted.where(F.length("_name") > length).select("_name", F.explode(F.array_distinct(grams)).alias("gram"))
    # A gram that no login has comes first, with 0 logins, and leaves no candidate.
    counted = tried.join(per_gram.select("gram", "logins"), "gram", "left")
    rarest = counted.groupBy("_name").agg(F.min_by("gram", F.struct(F.coalesce("logins", F.lit(0)), "gram")).alias("gram"))
    candidates = rarest.join(postings, "gram").where(F.col("login").contains(F.col("_name")))
    found = short.unionByName(candidates.groupBy("_name").agg(F.min("user_id").alias("matched_user_id")))
    return left_join_sparse(names.withColumn("_name", folded(F.col("name"))), found, "_name").drop("_name")
