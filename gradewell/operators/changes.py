"""Change sets applied to whole tables: new state and rejected rows out.

Each function takes all changes of a batch as a DataFrame. Where several rows
of a batch touch one key they count as requests one after another, in the order
of ``nr`` (the row's number in the batch). Files have no row updates, so write the
result to a new path.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.functions.scalar import is_member
from gradewell.operators.access import removal_check, user_roles
from gradewell.operators.cascade import cascade
from gradewell.operators.catalog import visible_questions
from gradewell.operators.counts import question_validity
from gradewell.operators.numbering import least_before, numbered, numbered_by_id, swept
from gradewell.operators.quality import (
    group_rules,
    problems,
    question_rules,
    template_rules,
    user_rules,
    with_multi_flag,
)
from gradewell.operators.ranking import recompute_group_ranking
from gradewell.operators.sampling import draw_options, drawable_options
from gradewell.operators.skew import own_shuffle, without
from gradewell.schema import (
    DEFAULT_RIGHTS,
    LIMBO_GROUP,
    LIMBO_USER,
    NEW_QUESTION_TEXT,
    NO_ANSWER,
    PUBLIC_GROUP,
    RANKS,
)
from gradewell.sources.shared import sized, stored


# Shared steps ---------------------------------------------------------------
def last_per_key(changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The last change of each key, fields renamed to ``_new_*``."""
    return changes.groupBy(key).agg(*[F.max_by(f, "nr").alias(f"_new_{f}") for f in fields])


def overlay(table: DataFrame, changes: DataFrame, key: str, fields: list[str], how: str = "left") -> DataFrame:
    """``table`` with the non-null ``_new_*`` fields of ``changes`` (one row per key) put over it.

    ``how="inner"`` gives the changed rows only.
    """
    joined = table.join(changes, key, how)
    return joined.select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns]
    )


def last_given(changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each field's last value that is not null, by key, fields renamed to ``_new_*``."""
    given = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("nr"))).alias(f"_new_{f}") for f in fields]
    return changes.groupBy(key).agg(*given)


def overlaid(changes: DataFrame, table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """For each change of a known key, the table's row with the change's fields over it, and ``nr``."""
    news = changes.select("nr", key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    # the table's side is narrowed to the batch's keys before rows of popular keys meet it
    return news.join(own_shuffle(table, key), key).select(
        "nr", *[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns]
    )


def missing_keys(changes: DataFrame, table: DataFrame, key: str, reason: str) -> DataFrame:
    return changes.join(table.select(key), key, "left_anti").select("nr", key, F.lit(reason).alias("powod"))


def with_new_ids(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Gives new rows (ordered by ``nr``) the ids after the table's highest one."""
    highest = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_m")).scalar()
    return numbered_by_id(rows, "nr", name="_i").withColumn(key, F.col("_i") + highest).drop("_i")


def _rejected(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter(F.col("powod").isNotNull()).select("nr", *columns, "powod")


def _accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("powod").isNull())


# Submissions ----------------------------------------------------------------
FORM = ["id_uz", "id_grupy", "id_quizu", "data_wyslania"]


def gate_submissions(
    submissions: DataFrame,
    quizzes: DataFrame,
    groups: DataFrame,
    access: DataFrame,
    rights: str = DEFAULT_RIGHTS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forms that may be handed in, forms that are refused (``powod``), and the memberships afterwards.

    A form (``FORM``; equal rows are one form) passes when its group can be
    entered, the quiz lies in that group and is not hidden. Whoever sends a form to an open
    group becomes a member, also when the quiz is then refused; an invite-only group takes
    members only. The first broken rule is the reason. Without ``id_grupy``, or where it is
    null, the form belongs to the quiz's own group.
    """
    judged = judged_submissions(submissions, quizzes, groups, access)
    accepted, refused, entered = sorted_submissions(judged, rights)
    return accepted, refused, access.select("id_grupy", "id_uz", "prawa_dost").unionByName(entered)


def judged_submissions(submissions: DataFrame, quizzes: DataFrame, groups: DataFrame, access: DataFrame) -> DataFrame:
    """The forms with the reason of their refusal (``powod``, null where there is none), and whether
    the user becomes a member by them (``wchodzi``)."""
    group = F.col("id_grupy") if "id_grupy" in submissions.columns else F.lit(None).cast("bigint")
    forms = submissions.select("id_uz", group.alias("id_grupy"), "id_quizu", "data_wyslania").distinct()
    quiz = quizzes.select("id_quizu", F.col("id_grupy").alias("_miejsce"), "ukryty", F.lit(True).alias("_quiz"))
    entry = groups.select("id_grupy", F.coalesce("na_zaproszenie", F.lit(False)).alias("_zamknieta"))
    member = access.select("id_uz", "id_grupy").distinct().withColumn("_czlonek", F.lit(True))
    found = (
        forms.join(quiz, "id_quizu", "left")
        .withColumn("id_grupy", F.coalesce("id_grupy", "_miejsce"))
        .join(entry, "id_grupy", "left")
        .join(member, ["id_uz", "id_grupy"], "left")
    )
    turned_away = (
        F.when(F.col("id_uz").isNull(), "no_user")
        .when(F.col("_zamknieta").isNull() & (F.col("id_grupy").isNotNull() | F.col("_quiz").isNotNull()), "no_group")
        .when(F.col("_zamknieta") & F.col("_czlonek").isNull(), "invite_only")
    )
    refused = (
        F.when(F.col("_quiz").isNull(), "no_quiz")
        .when(~F.col("id_grupy").eqNullSafe(F.col("_miejsce")), "wrong_group")
        .when(F.col("ukryty"), "hidden")
    )
    judged = found.withColumns({"_wstep": turned_away, "powod": F.coalesce(turned_away, refused)})
    enters = F.col("_wstep").isNull() & F.col("_czlonek").isNull() & F.col("_zamknieta").isNotNull()
    return judged.select(*FORM, "powod", enters.alias("wchodzi"))


def sorted_submissions(judged: DataFrame, rights: str = DEFAULT_RIGHTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forms of ``judged_submissions`` that may be handed in, refused ones, and the new memberships."""
    entered = judged.filter("wchodzi").select("id_grupy", "id_uz").distinct().withColumn("prawa_dost", F.lit(rights))
    return _accepted(judged).select(*FORM), judged.filter("powod IS NOT NULL").select(*FORM, "powod"), entered


def refused_entries(submissions: DataFrame, questions: DataFrame) -> DataFrame:
    """Entries that no shown question takes, with the reason: unknown, of another quiz, or hidden."""
    of = questions.select("id_pyt", F.col("id_quizu").alias("_quiz"), "ukryty", F.lit(True).alias("_jest"))
    reason = (
        F.when(F.col("_jest").isNull(), "no_question")
        .when(~F.col("_quiz").eqNullSafe(F.col("id_quizu")), "other_quiz")
        .when(F.col("ukryty"), "hidden_question")
    )
    entries = submissions.filter("id_pyt IS NOT NULL").select("id_uz", "id_quizu", "data_wyslania", "id_pyt")
    judged = entries.join(of, "id_pyt", "left").withColumn("powod", reason).filter("powod IS NOT NULL")
    return judged.select("id_uz", "id_quizu", "data_wyslania", "id_pyt", "powod").distinct()


def shown_options(
    submissions: DataFrame,
    questions: DataFrame,
    types: DataFrame,
    templates: DataFrame,
    seed: str,
    accepted: DataFrame | None = None,
) -> DataFrame:
    """Every option put before a user in a submission, with what the user did with it.

    ``zaznaczona``: ticked. For open questions it tells whether the entered text
    contains the option's text, which is what decides about its comment.
    ``accepted``: the forms that count (``gate_submissions``); all if not given.
    """
    forms = submissions if accepted is None else accepted
    form = ["id_uz", "data_wyslania"]
    # an attempt is one row, with all its entries, until it meets its questions
    attempts = forms.select("id_uz", "id_quizu", "data_wyslania").repartition(*form).distinct()
    # a form may arrive more than once; of differing rows for one question the greatest counts
    entries = submissions.filter(F.col("id_pyt").isNotNull()).select(*form, "id_pyt", F.struct("open_text", "chosen").alias("_wpis"))
    entries = entries.repartition(*form).groupBy(*form, "id_pyt").agg(F.max("_wpis").alias("_wpis"))
    entered = entries.groupBy(*form).agg(F.map_from_entries(F.collect_list(F.struct("id_pyt", "_wpis"))).alias("_wpisy"))
    options = drawable_options(visible_questions(questions), types, templates)
    asked = attempts.join(entered, form, "left").join(options, "id_quizu").withColumn("_wpis", F.col("_wpisy")[F.col("id_pyt")])
    drawn = draw_options(asked.select("*", "_wpis.*").drop("_wpisy", "_wpis"), seed)
    ticked = F.when(
        F.col("rodzaj") == "open",
        F.coalesce(F.contains("open_text", "tresc_odp"), F.lit(False)),
    ).otherwise(is_member("chosen", F.col("tresc_odp")))
    return drawn.withColumn("zaznaczona", ticked).drop("chosen")


def expand_submissions(shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User answers of all submissions, and closed questions that could not be shown.

    ``shown`` comes from ``shown_options``. An open question gives one ticked row
    with the entered text, a closed one a row per option.
    """
    is_open = F.col("rodzaj") == "open"
    answers = shown.filter(is_open | ~F.col("blad")).select(
        "id_uz",
        "id_pyt",
        "data_wyslania",
        F.when(is_open, F.coalesce("open_text", F.lit(NO_ANSWER))).otherwise(F.col("tresc_odp")).alias("tresc_odp"),
        (is_open | F.col("zaznaczona")).alias("zaznaczona"),
    )
    failed = shown.filter(F.col("blad") & (F.col("place") == 1)).select("id_uz", "id_pyt", "data_wyslania")
    return answers, failed


def with_answer_ids(answers: DataFrame, existing: DataFrame) -> DataFrame:
    """Numbers new answers after the highest ``id_odp_u``, in order of time."""
    highest = existing.agg(F.coalesce(F.max("id_odp_u"), F.lit(0)).alias("_m")).scalar()
    order = ["data_wyslania", "id_uz", "id_pyt", "tresc_odp", "zaznaczona"]
    return (
        numbered(
            answers,
            [F.col(c) for c in order],
            name="_i",
        )
        .withColumn("id_odp_u", F.col("_i") + highest)
        .drop("_i")
    )


# Membership -----------------------------------------------------------------
def enroll_visits(
    visits: DataFrame, groups: DataFrame, access: DataFrame, rights: str = DEFAULT_RIGHTS
) -> tuple[DataFrame, DataFrame]:
    """Visitors of open groups become members; others are turned away."""
    outsiders = without(visits.select("id_uz", "id_grupy").distinct(), access, ["id_uz", "id_grupy"])
    judged = outsiders.join(groups.select("id_grupy", "na_zaproszenie"), "id_grupy", "left").withColumn(
        "powod",
        F.when(F.col("na_zaproszenie").isNull(), "no_group").when(F.col("na_zaproszenie"), "invite_only"),
    )
    fresh = _accepted(judged).select("id_grupy", "id_uz", F.lit(rights).alias("prawa_dost"))
    rejected = judged.filter(F.col("powod").isNotNull()).select("id_uz", "id_grupy", "powod")
    return access.select("id_grupy", "id_uz", "prawa_dost").unionByName(fresh), rejected


def remove_members(
    requests: DataFrame, users: DataFrame, groups: DataFrame, access: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Removes members where ``removal_check`` says ok."""
    judged = removal_check(requests, users, groups, access)
    gone = judged.filter(F.col("werdykt") == "ok").select("id_uz", "id_grupy")
    return access.join(gone, ["id_uz", "id_grupy"], "left_anti").select(
        "id_grupy", "id_uz", "prawa_dost"
    ), judged.filter(F.col("werdykt") != "ok")


# Quizzes and questions --------------------------------------------------------
def set_quiz_visibility(changes: DataFrame, quizzes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Publishes or hides quizzes: (nr, id_quizu, ukryty)."""
    state = overlay(quizzes, last_per_key(changes, "id_quizu", ["ukryty"]), "id_quizu", ["ukryty"])
    return state, missing_keys(changes, quizzes, "id_quizu", "no_quiz")


def toggle_questions(
    requests: DataFrame, questions: DataFrame, types: DataFrame, templates: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Flips the hidden flag once per request row; showing needs a valid question.

    A valid question flips every time. An invalid one can only be hidden, so one
    request at most has an effect and the rest are refused. ``odmowy`` counts them.
    """
    asked = requests.groupBy("id_pyt").agg(F.count("*").alias("_n"))
    # validity is worked out for the batch's questions only
    named = asked.select("id_pyt")
    mine, theirs = (df.join(named, "id_pyt", "left_semi") for df in (questions, templates))
    judged = asked.join(mine.select("id_pyt", "ukryty"), "id_pyt", "left").join(
        question_validity(mine, types, theirs).select("id_pyt", "poprawne"), "id_pyt", "left"
    )
    flipped = F.when(F.col("poprawne"), F.col("ukryty") != (F.col("_n") % 2 == 1)).otherwise(F.lit(True))
    refused = (
        F.when(F.col("ukryty").isNull(), F.col("_n"))
        .when(F.col("poprawne"), 0)
        .otherwise(F.col("_n") - F.when(F.col("ukryty"), 0).otherwise(1))
    )
    news = judged.filter(F.col("ukryty").isNotNull()).select("id_pyt", flipped.alias("_new_ukryty"))
    rejects = judged.withColumn("odmowy", refused).filter("odmowy > 0").select(
        "id_pyt",
        F.when(F.col("ukryty").isNull(), "no_question").otherwise("invalid").alias("powod"),
        "odmowy",
    )
    return overlay(questions, news, "id_pyt", ["ukryty"]), rejects


QUESTION_FIELDS = ["tresc", "id_typu", "pkt", "id_kategorii"]


def update_questions(
    changes: DataFrame, questions: DataFrame, types: DataFrame, templates: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Applies field changes (nr, id_pyt, fields; null keeps the old value) row by row.

    A row that would break ``question_rules`` is refused alone; a field's last accepted
    value counts. A question that is not valid after one of its accepted rows is
    hidden, also if a later row makes it valid again.
    """
    own = overlaid(changes, questions, "id_pyt", QUESTION_FIELDS)
    broken = F.array_join(problems(question_rules()), ",")
    judged = own.select("nr", "id_pyt", F.when(broken != "", broken).alias("powod"))
    accepted = changes.join(_accepted(judged).select("nr"), "nr", "left_semi")
    news = last_given(accepted, "id_pyt", QUESTION_FIELDS)

    # every type that a question had after an accepted row; its old one only if the first row keeps it
    keeps = accepted.groupBy("id_pyt").agg(F.min_by(F.col("id_typu").isNull(), "nr").alias("_stary"))
    kept = questions.select("id_pyt", "id_typu").join(keeps.filter("_stary").select("id_pyt"), "id_pyt", "left_semi")
    given = accepted.filter("id_typu IS NOT NULL").select("id_pyt", "id_typu")
    had = kept.union(given).distinct()
    mine = templates.join(keeps.select("id_pyt"), "id_pyt", "left_semi")
    validity = question_validity(had, types, mine).groupBy("id_pyt").agg(F.min("poprawne").alias("_zawsze"), F.count("*").alias("_typy"))
    known = had.groupBy("id_pyt").agg(F.count("*").alias("_wszystkie")).join(validity, "id_pyt", "left")
    never = known.filter(~F.coalesce(F.col("_zawsze") & (F.col("_typy") == F.col("_wszystkie")), F.lit(False)))
    state = overlay(questions, news, "id_pyt", QUESTION_FIELDS)
    state = state.join(never.select("id_pyt", F.lit(True).alias("_ukryj")), "id_pyt", "left")
    state = state.withColumn("ukryty", F.col("ukryty") | F.coalesce("_ukryj", F.lit(False)))
    rejects = _rejected(judged, "id_pyt").unionByName(missing_keys(changes, questions, "id_pyt", "no_question"))
    return state.select(*questions.columns), rejects


def apply_option_changes(
    changes: DataFrame, templates: DataFrame, questions: DataFrame, types: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Template answers added, changed and deleted, row by row.

    ``changes``: nr, op (create, update, delete), id_pyt, tresc_odp,
    poziom_poprawnosci, komentarz, kiedy. Update and delete find their row by
    (id_pyt, tresc_odp): of the rows that are there at that moment, created ones
    included, the lowest id. ``kiedy`` becomes the modification time.

    The rows of one (id_pyt, tresc_odp) form a queue: creating appends, deleting takes
    the head, updating meets the head. With +1 and -1 for these, the running sum and its
    running minimum tell which row is the head, and where there was none. Both are swept, so a
    long queue spreads over tasks; the judged rows are stored, and all that follows reads them.
    """
    by = ["id_pyt", "tresc_odp"]
    fields = ["poziom_poprawnosci", "komentarz"]
    held = templates.join(changes.select(*by).distinct(), by, "left_semi").groupBy(*by).agg(F.count("*").alias("_bylo"))
    found = with_multi_flag(changes, questions, types).join(own_shuffle(held, "id_pyt"), by, "left")
    rules = template_rules()
    new_broken = F.array_join(problems(rules), ",")
    changed_rules = {k: v for k, v in rules.items() if k not in ("tresc_odp_pusta", "poziom_pusty")}
    changed_broken = F.array_join(problems(changed_rules), ",")
    is_new, known = F.col("op") == "create", F.col("wielokrotnego_wyboru").isNotNull()
    step = F.when(known & is_new & (new_broken == ""), 1).when(known & (F.col("op") == "delete"), -1).otherwise(0)
    found = found.withColumns({"_bylo": F.coalesce("_bylo", F.lit(0)), "_krok": step})
    counts = {"_krokow": F.col("_krok"), "_odjete": (F.col("_krok") == -1).cast("int"), "_dodane": (F.col("_krok") == 1).cast("int")}
    found = swept(found, [F.col("nr")], counts, by=by, keep_part=True).withColumn("_suma", F.col("_bylo") + F.col("_krokow"))
    found = least_before(found, [F.col("nr")], "_suma", "_dno_przed", by)
    found = found.withColumn("_dno_przed", F.least(F.coalesce("_dno_przed", F.lit(0)), F.lit(0)))
    dno = F.least("_dno_przed", "_suma")
    there = F.col("_suma") - F.col("_krok") - F.col("_dno_przed")  # rows in the queue before this one
    reason = (
        F.when(~known, "no_question")
        .when(~is_new & (there <= 0), "no_template")
        .when(is_new & (new_broken != ""), new_broken)
        .when((F.col("op") == "update") & (changed_broken != ""), changed_broken)
    )
    judged = found.select(
        *changes.columns,
        reason.alias("powod"),
        (F.col("_odjete") + dno).alias("_usuniete"),
        (F.col("_bylo") + F.col("_dodane")).alias("_miejsce"),
    )
    judged = sized(stored(judged, "option-changes"))

    created = with_new_ids(
        _accepted(judged)
        .filter(is_new)
        .select("nr", *by, *fields, F.col("kiedy").alias("ost_modyfikacja"), "_miejsce"),
        templates,
        "id_odp_w",
    )
    columns = ["id_odp_w", "id_pyt", "tresc_odp", *fields, "ost_modyfikacja"]
    taken = judged.groupBy(*by).agg(F.max("_usuniete").alias("_glowa"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("id_odp_w")).cast("long")
    touched = templates.join(own_shuffle(taken, "id_pyt"), by).select(*columns, "_glowa", place.alias("_miejsce"))
    created = created.join(own_shuffle(taken, "id_pyt"), by).select(*columns, "_glowa", "_miejsce")
    edits = _accepted(judged).filter("op = 'update'").withColumn("_miejsce", F.col("_usuniete") + 1)
    edits = edits.groupBy(*by, "_miejsce").agg(
        F.max_by("kiedy", "nr").alias("_new_ost_modyfikacja"),
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("nr"))).alias(f"_new_{f}") for f in fields],
    )
    alive = touched.unionByName(created).filter("_miejsce > _glowa").join(own_shuffle(edits, "id_pyt"), [*by, "_miejsce"], "left")
    alive = alive.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in (*fields, "ost_modyfikacja") else F.col(c) for c in columns])
    others = templates.join(taken, by, "left_anti").select(*columns)
    return others.unionByName(alive), _rejected(judged, "op", "id_pyt", "tresc_odp")


def _limbo_moves(changes: DataFrame, quizzes: DataFrame, limbo_only: bool) -> DataFrame:
    """Changes with ``powod`` set where the quiz is missing or not in the holding area."""
    state = quizzes.select("id_quizu", F.col("id_grupy").alias("_grupa"))
    reason = F.when(F.col("_grupa").isNull(), "no_quiz")
    if limbo_only:
        reason = reason.when(F.col("_grupa") != LIMBO_GROUP, "not_in_limbo")
    return changes.join(state, "id_quizu", "left").withColumn("powod", reason)


def transfer_ownership(
    changes: DataFrame, quizzes: DataFrame, limbo_only: bool = True
) -> tuple[DataFrame, DataFrame]:
    """New owners (nr, id_quizu, id_wlasciciela) for quizzes in the holding area."""
    judged = _limbo_moves(changes, quizzes, limbo_only)
    news = last_per_key(_accepted(judged), "id_quizu", ["id_wlasciciela"])
    return overlay(quizzes, news, "id_quizu", ["id_wlasciciela"]), _rejected(judged, "id_quizu")


def move_quizzes(
    changes: DataFrame, quizzes: DataFrame, groups: DataFrame, limbo_only: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves quizzes (nr, id_quizu, id_grupy); also gives the groups that gained one, once per quiz.

    A quiz leaves the holding area with its first accepted move to another group, and
    later moves find it gone (``not_in_limbo``). With ``limbo_only=False`` the last one counts.
    """
    known = groups.select("id_grupy", F.lit(True).alias("_jest"))
    judged = _limbo_moves(changes, quizzes, limbo_only).join(known, "id_grupy", "left")
    judged = judged.withColumn("powod", F.when(F.col("_jest").isNull(), "no_group").otherwise(F.col("powod")))
    if limbo_only:
        leaving = _accepted(judged).filter(F.col("id_grupy") != LIMBO_GROUP).groupBy("id_quizu")
        news = leaving.agg(F.min_by("id_grupy", "nr").alias("_new_id_grupy"), F.min("nr").alias("_kiedy"))
        judged = judged.join(own_shuffle(news.select("id_quizu", "_kiedy"), "id_quizu"), "id_quizu", "left")
        late = F.when(F.col("nr") > F.col("_kiedy"), "not_in_limbo")
        judged = judged.withColumn("powod", F.coalesce("powod", late))
        news = news.drop("_kiedy")
    else:
        news = last_per_key(_accepted(judged), "id_quizu", ["id_grupy"])
    touched = news.select(F.col("_new_id_grupy").alias("id_grupy"))
    return (
        overlay(quizzes, news, "id_quizu", ["id_grupy"]),
        _rejected(judged, "id_quizu", "id_grupy"),
        touched,
    )


def transfer_to_group(
    changes: DataFrame,
    quizzes: DataFrame,
    groups: DataFrame,
    ranking: DataFrame,
    answers: DataFrame,
    questions: DataFrame,
    types: DataFrame,
    templates: DataFrame,
    limbo_only: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves quizzes out of the holding area and recomputes the rankings of their new groups."""
    state, rejects, touched = move_quizzes(changes, quizzes, groups, limbo_only)
    fresh = recompute_group_ranking(ranking, touched, answers, questions, types, templates, state)
    return state, fresh, rejects


def delete_quiz_answers(
    requests: DataFrame, answers: DataFrame, questions: DataFrame, quizzes: DataFrame, limbo_only: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Deletes the user answers of quizzes (nr, id_quizu)."""
    judged = _limbo_moves(requests, quizzes, limbo_only)
    doomed = questions.join(_accepted(judged).select("id_quizu"), "id_quizu", "left_semi").select("id_pyt")
    return answers.join(doomed, "id_pyt", "left_anti").select(*answers.columns), _rejected(judged, "id_quizu")


def create_quizzes(requests: DataFrame, quizzes: DataFrame, at: Column) -> DataFrame:
    """New quizzes from (nr, id_wlasciciela, nazwa, id_grupy); group 1 and visible by default."""
    kinds = dict(quizzes.dtypes)
    fresh = with_new_ids(requests, quizzes, "id_quizu").select(
        "id_quizu",
        "id_wlasciciela",
        "nazwa",
        F.coalesce("id_grupy", F.lit(PUBLIC_GROUP)).cast("bigint").alias("id_grupy"),
        F.lit(None).cast(kinds["limit_podejsc"]).alias("limit_podejsc"),
        F.lit(None).cast("string").alias("limit_czasowy"),
        at.alias("data_utworzenia"),
        F.lit(False).alias("ukryty"),
    )
    return quizzes.select(*fresh.columns).unionByName(fresh)


def create_questions(
    requests: DataFrame,
    questions: DataFrame,
    types: DataFrame,
    categories: DataFrame,
    at: Column,
    text: str = NEW_QUESTION_TEXT,
) -> DataFrame:
    """New hidden questions from (nr, id_quizu, id_autora) with the default type and category."""
    default_type = types.agg(F.min("id_typu").alias("_t")).scalar()
    default_category = categories.agg(F.min("id_kategorii").alias("_k")).scalar()
    fresh = with_new_ids(requests, questions, "id_pyt").select(
        "id_pyt",
        F.format_string(text, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("tresc"),
        default_type.cast("bigint").alias("id_typu"),
        "id_autora",
        F.lit(1.0).alias("pkt"),
        "id_quizu",
        default_category.cast("bigint").alias("id_kategorii"),
        F.lit(True).alias("ukryty"),
    )
    return questions.select(*fresh.columns).unionByName(fresh)


def _taken(rows: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Adds ``_taken_<column>``: the table has the value already, or an earlier row asks for it.

    Only values of the batch are looked up in the table, and all facts are gathered per value,
    so rows meet them in one join.
    """
    asked = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min("nr").alias("_first"))
    owners = table.join(rows.select(column).distinct(), column, "left_semi").select(column, F.lit(True).alias("_there")).distinct()
    facts = asked.join(owners, column, "full")
    taken = F.coalesce(F.col("_there") | (F.col("_first") < F.col("nr")), F.col("_first") < F.col("nr"), F.lit(False))
    return rows.join(own_shuffle(facts, column), column, "left").select(*rows.columns, taken.alias(f"_taken_{column}"))


def create_groups(requests: DataFrame, groups: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New groups from (nr, id_wlasciciela, nazwa, na_zaproszenie, haslo); teachers and superusers only."""
    may = user_roles(users).select(
        F.col("id_uz").alias("id_wlasciciela"), F.col("moze_tworzyc_grupy").alias("_moze")
    )
    broken = F.array_join(problems(group_rules()), ",")
    checked = requests.join(may, "id_wlasciciela", "left").withColumn(
        "powod",
        F.when(~F.coalesce("_moze", F.lit(False)), "no_privilege").when(broken != "", broken),
    )
    # only rows that could be created compete for a name
    rivals = _accepted(checked).drop("powod")
    fit = _taken(rivals, groups, "nazwa").withColumn(
        "powod", F.when(F.col("_taken_nazwa"), "name_taken")
    )
    fresh = with_new_ids(_accepted(fit), groups, "id_grupy").select(
        "id_grupy",
        "id_wlasciciela",
        "nazwa",
        F.coalesce("na_zaproszenie", F.lit(False)).alias("na_zaproszenie"),
        "haslo",
    )
    rejects = _rejected(checked, "nazwa").unionByName(_rejected(fit, "nazwa"))
    return groups.select(*fresh.columns).unionByName(fresh), rejects


def delete_questions_quizzes(
    quiz_ids: DataFrame,
    question_ids: DataFrame,
    quizzes: DataFrame,
    questions: DataFrame,
    templates: DataFrame,
    answers: DataFrame,
    posts: DataFrame,
) -> dict[str, DataFrame]:
    """Deletes quizzes and questions with everything below them: questions, their template and
    user answers, and the posts about a quiz."""
    tables = {"quiz": quizzes, "pytanie": questions, "odpowiedz_wzorcowa": templates, "odpowiedz_uzytkownika": answers, "dyskusja": posts}
    return cascade({"quiz": quiz_ids, "pytanie": question_ids}, tables)


def delete_users(user_ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Deletes users and returns every table that knows of users, without a key that points to
    a deleted one. The limbo user stays.

    Quizzes of a deleted user go to the holding area; groups and questions pass to the limbo
    user. Memberships, ranking rows, answers and posts of a deleted user go.
    """
    return cascade({"uzytkownik": user_ids}, tables)


PROFILE_FIELDS = ["nazwa_uz", "login", "email"]


def _stacked(fields: list[str]) -> Column:
    """The fields of a row as an array of (pole, wartosc)."""
    return F.array(*[F.struct(F.lit(f).alias("pole"), F.col(f).alias("wartosc")) for f in fields])


def _with_lost_values(checked: DataFrame, users: DataFrame, key: str | None = None) -> DataFrame:
    """``checked`` (nr, fields, powod) with the fields that a row may not have added to ``powod``:
    another user has the value, or it is free and an earlier row that keeps the rules asks for it.

    ``key``: whose row it is; a user's own value, or own earlier row, is in nobody's way. The fields
    are put under one another, so values meet their rivals and their owners in one join.
    """
    who = F.col(key) if key else F.lit(None).cast("long")
    asked = checked.select("nr", who.alias("_who"), "powod", F.explode(_stacked(PROFILE_FIELDS)).alias("_p"))
    asked = asked.select("nr", "_who", "powod", "_p.*").filter("wartosc IS NOT NULL")
    first = _accepted(asked).groupBy("pole", "wartosc").agg(F.min("nr").alias("_first"), F.min_by("_who", "nr").alias("_first_who"))
    held = users.select("id_uz", F.explode(_stacked(PROFILE_FIELDS)).alias("_p")).select("id_uz", "_p.*")
    held = held.join(asked.select("pole", "wartosc").distinct(), ["pole", "wartosc"], "left_semi")
    held = held.groupBy("pole", "wartosc").agg(F.min("id_uz").alias("_k1"), F.max("id_uz").alias("_k2"))
    facts = first.join(held, ["pole", "wartosc"], "full")
    by_other = F.col("_k1").isNotNull() & ~(F.col("_k1").eqNullSafe(F.col("_who")) & F.col("_k2").eqNullSafe(F.col("_who")))
    before = (F.col("_first") < F.col("nr")) & (F.col("_who").isNull() | (F.col("_first_who") != F.col("_who")))
    lost = asked.join(own_shuffle(facts, "wartosc"), ["pole", "wartosc"]).filter(by_other | (F.col("_k1").isNull() & before))
    lost = lost.groupBy("nr").agg(F.collect_set("pole").alias("_pola"))
    taken = F.array_join(problems({f"{f}_zajete": F.array_contains("_pola", f) for f in PROFILE_FIELDS}), ",")
    both = F.concat_ws(",", "powod", F.when(F.col("_pola").isNotNull(), taken))
    return checked.join(lost, "nr", "left").withColumn("powod", F.when(both != "", both)).drop("_pola")


def create_users(requests: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New users from (nr, login, nazwa_uz, email): the table with them, and the refused rows.

    A row is refused alone: when ``user_rules`` break, when a user of the table has one of its
    values, or when an earlier row that keeps the rules asks for the same one. New users have the
    rank ``user`` and the ids after the highest one, in the order of ``nr``.
    """
    rules = F.array_join(problems(user_rules()), ",")
    checked = requests.select("nr", *PROFILE_FIELDS, F.when(rules != "", rules).alias("powod"))
    judged = sized(stored(_with_lost_values(sized(stored(checked, "new-users")), users), "new-users"))
    fresh = with_new_ids(_accepted(judged), users, "id_uz").select(*["id_uz", *PROFILE_FIELDS, F.lit(RANKS[0]).alias("ranga")])
    columns = ["id_uz", "login", "nazwa_uz", "email", "ranga"]
    return users.select(columns).unionByName(fresh.select(columns)), _rejected(judged, "login")


def update_profiles(changes: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies (nr, id_uz, nazwa_uz, login, email) row by row; null keeps the old value.

    Every row is judged by itself and refused alone: when ``user_rules`` break with
    its fields put over the table's, when a value it sets belongs to another user of
    the table, or when an earlier row of another user that keeps the rules asks for
    the same free value. A field's last accepted value counts. A value that the
    batch frees can be taken from the next batch on.
    """
    own = overlaid(changes, users, "id_uz", PROFILE_FIELDS)
    rules = F.array_join(problems(user_rules()), ",")
    checked = own.select("nr", F.when(rules != "", rules).alias("powod"))
    checked = sized(stored(changes.select("nr", "id_uz", *PROFILE_FIELDS).join(checked, "nr"), "profile-changes"))

    judged = _with_lost_values(checked, users, key="id_uz")
    news = last_given(_accepted(judged), "id_uz", PROFILE_FIELDS)
    rejects = _rejected(judged, "id_uz").unionByName(missing_keys(changes, users, "id_uz", "no_user"))
    return overlay(users, news, "id_uz", PROFILE_FIELDS), rejects
