"""DuckDB SQL for each registered query, written apart from the Spark code."""

from checks.oracle_requests import REQUESTS
from checks.oracle_tables import may, with_tables

# child table, foreign key, parent table; a parent's key has the name given, or the same as the child's
REFERENCES = """
dostep_grupa.id_uz uzytkownik, dostep_grupa.id_grupy grupa_quizowa, dyskusja.id_quizu quiz, dyskusja.id_uz uzytkownik,
grupa_quizowa.id_wlasciciela uzytkownik.id_uz, odpowiedz_uzytkownika.id_uz uzytkownik,
odpowiedz_uzytkownika.id_pyt pytanie, odpowiedz_wzorcowa.id_pyt pytanie,
podkategoria.id_nadkategorii kategoria.id_kategorii, podkategoria.id_podkategorii kategoria.id_kategorii,
pytanie.id_typu typ, pytanie.id_autora uzytkownik.id_uz, pytanie.id_quizu quiz, pytanie.id_kategorii kategoria,
quiz.id_wlasciciela uzytkownik.id_uz, quiz.id_grupy grupa_quizowa, ranking.id_uz uzytkownik, ranking.id_grupy grupa_quizowa
"""

SEED = "losowanie"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,4}"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
BLANK = r"^\s*$"


def _two_lines(table: str, key: str) -> str:
    return rf"""
SELECT zrodlo, nr // 2 AS blok, max(trim(linia, {SPACES})) FILTER (WHERE nr % 2 = 0) AS pytanie,
  list(trim(linia, {SPACES}) ORDER BY nr) FILTER (WHERE nr % 2 > 0) AS odpowiedzi
FROM (SELECT zrodlo, unnest(l) AS linia, generate_subscripts(l, 1) - 1 AS nr
  FROM (SELECT {key} AS zrodlo, string_split_regex(regexp_replace(text, '\r?\n\z', ''), '\r?\n') AS l FROM {table} WHERE length(text) > 0))
GROUP BY ALL"""


def _band(score: str, top: str) -> str:
    return f"""CASE WHEN {score} < 0.25 * {top} THEN 'bad-score'
                    WHEN {score} < 0.75 * {top} THEN 'mediocre-score' ELSE 'good-score' END"""


# Steps shared by several checks
STEPS = {
    # options drawn for every user and visible question of the quizzes they took
    "ciagniecie": f"""
SELECT d.id_uz, d.id_pyt, w.id_odp_w, w.tresc_odp, w.poziom_poprawnosci, w.komentarz, t.liczba_odp,
  row_number() OVER (PARTITION BY d.id_uz, d.id_pyt
                     ORDER BY md5('{SEED}:' || d.id_uz || ':' || w.id_odp_w), w.id_odp_w) AS place
FROM (SELECT DISTINCT a.id_uz, p.id_pyt, p.id_typu FROM attempts a JOIN pytanie p USING (id_quizu)
      WHERE NOT p.ukryty) d JOIN typ t USING (id_typu) JOIN odpowiedz_wzorcowa w ON w.id_pyt = d.id_pyt""",
    "pelne": """
SELECT id_pyt, arg_min(w, id_odp_w) AS w FROM odpowiedz_wzorcowa w WHERE poziom_poprawnosci = 100 GROUP BY id_pyt""",
    "wylosowane": """
SELECT c.id_uz, c.id_pyt, c.place,
  CASE WHEN swap THEN f.w.id_odp_w ELSE c.id_odp_w END AS id_odp_w,
  CASE WHEN swap THEN f.w.tresc_odp ELSE c.tresc_odp END AS tresc_odp,
  CASE WHEN swap THEN f.w.poziom_poprawnosci ELSE c.poziom_poprawnosci END AS poziom_poprawnosci,
  CASE WHEN swap THEN f.w.komentarz ELSE c.komentarz END AS komentarz,
  f.id_pyt IS NULL AS blad
FROM (SELECT *, place = 1 AND max(poziom_poprawnosci) OVER (PARTITION BY id_uz, id_pyt) < 100 AS maybe
      FROM ciagniecie WHERE place <= liczba_odp) c
LEFT JOIN pelne f ON f.id_pyt = c.id_pyt, LATERAL (SELECT c.maybe AND f.id_pyt IS NOT NULL AS swap) s""",
    "wpisy": """
SELECT l_orderkey AS o_orderkey, l_linenumber AS k, list(DISTINCT l_returnflag) AS chosen,
  min(l_returnflag) AS open_text FROM lineitem GROUP BY ALL""",
    "ocenione": """
SELECT f.*, CASE
  WHEN f.id_grupy NOT IN (SELECT id_grupy FROM grupa_quizowa) THEN 'no_group'
  WHEN f.id_grupy IN (SELECT id_grupy FROM grupa_quizowa WHERE na_zaproszenie)
    AND NOT EXISTS (SELECT 1 FROM dostep_grupa d WHERE d.id_uz = f.id_uz AND d.id_grupy = f.id_grupy) THEN 'invite_only'
  WHEN f.id_quizu NOT IN (SELECT id_quizu FROM quiz) THEN 'no_quiz'
  WHEN f.id_grupy <> (SELECT q.id_grupy FROM quiz q WHERE q.id_quizu = f.id_quizu) THEN 'wrong_group'
  WHEN f.id_quizu IN (SELECT id_quizu FROM quiz WHERE ukryty) THEN 'hidden' END AS powod
FROM (SELECT *, id_quizu % 25 + CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END AS id_grupy FROM attempts) f""",
    "przyjete": "SELECT * FROM ocenione WHERE powod IS NULL",
    "pokazane": """
SELECT a.id_uz, p.id_pyt, a.data_wyslania, x.place, x.id_odp_w, x.tresc_odp, x.komentarz, x.blad,
  p.id_typu = 11 AS otwarte, e.open_text,
  CASE WHEN p.id_typu = 11 THEN coalesce(contains(e.open_text, x.tresc_odp), false)
       ELSE coalesce(list_contains(e.chosen, x.tresc_odp), false) END AS zaznaczona
FROM przyjete a JOIN pytanie p USING (id_quizu) JOIN wylosowane x ON x.id_uz = a.id_uz AND x.id_pyt = p.id_pyt
LEFT JOIN wpisy e ON e.o_orderkey = a.o_orderkey AND e.k = p.id_pyt % 10
WHERE NOT p.ukryty""",
    "wyslane": """
SELECT id_uz, id_pyt, data_wyslania,
  CASE WHEN otwarte THEN coalesce(open_text, 'nil') ELSE tresc_odp END AS tresc_odp,
  otwarte OR zaznaczona AS zaznaczona
FROM pokazane WHERE otwarte OR NOT blad""",
    "werdykty": f"""
SELECT w.*, CASE
  WHEN NOT EXISTS (SELECT 1 FROM grupa_quizowa g WHERE g.id_grupy = w.id_grupy) THEN 'no_group'
  WHEN NOT EXISTS (SELECT 1 FROM uzytkownik u WHERE u.id_uz = w.id_uz) THEN 'no_user'
  WHEN NOT EXISTS (SELECT 1 FROM dostep_grupa d WHERE d.id_uz = w.id_uz AND d.id_grupy = w.id_grupy) THEN 'not_enrolled'
  WHEN (SELECT id_wlasciciela FROM grupa_quizowa g WHERE g.id_grupy = w.id_grupy) = w.id_uz THEN 'is_owner'
  WHEN w.id_aktora <> w.id_uz AND NOT {may("w.id_aktora", "w.id_grupy", 16)} THEN 'no_privilege'
  ELSE 'ok' END AS werdykt
FROM wypisy w""",
    "widoczne": """
SELECT u.id_uz, g.id_grupy, row_number() OVER (PARTITION BY u.id_uz ORDER BY g.id_grupy) AS place
FROM uzytkownik u, grupa_quizowa g
WHERE g.id_grupy <> 0 AND (u.ranga IN ('moderator', 'administrator') OR NOT (g.na_zaproszenie AND
  EXISTS (SELECT 1 FROM dostep_grupa d WHERE d.id_uz = u.id_uz AND d.id_grupy = g.id_grupy)))""",
    "widoczne_dok": """
SELECT u.id_uz, g.id_grupy, row_number() OVER (PARTITION BY u.id_uz ORDER BY g.id_grupy) AS place
FROM uzytkownik u, grupa_quizowa g
WHERE g.id_grupy <> 0 AND (u.ranga IN ('moderator', 'administrator') OR NOT g.na_zaproszenie OR
  EXISTS (SELECT 1 FROM dostep_grupa d WHERE d.id_uz = u.id_uz AND d.id_grupy = g.id_grupy))""",
    "liczby_uz": """
SELECT g.id_grupy, count(u.id_uz) AS uzytkownicy FROM grupa_quizowa g
LEFT JOIN dostep_grupa d ON d.id_grupy = g.id_grupy
LEFT JOIN uzytkownik u ON u.id_uz = d.id_uz AND u.id_uz <> 0 AND u.ranga NOT IN ('moderator', 'administrator')
GROUP BY g.id_grupy""",
    "liczby_quiz": """
SELECT g.id_grupy, count(q.id_quizu) AS quizy FROM grupa_quizowa g
LEFT JOIN quiz q ON q.id_grupy = g.id_grupy AND NOT q.ukryty GROUP BY g.id_grupy""",
    "karty": """
SELECT id_grupy, nazwa, CASE WHEN na_zaproszenie THEN 'TAK' ELSE 'NIE' END AS na_zaproszenie,
  CASE WHEN trim(coalesce(haslo, '')) = '' THEN 'NIE' ELSE 'TAK' END AS chroniona_haslem FROM grupa_quizowa""",
    "czlonkowie": """
SELECT d.id_grupy, d.id_uz, u.nazwa_uz, d.id_uz <> g.id_wlasciciela AS usuwalny,
  row_number() OVER (PARTITION BY d.id_grupy ORDER BY d.id_uz) AS place
FROM dostep_grupa d JOIN grupa_quizowa g USING (id_grupy) JOIN uzytkownik u ON u.id_uz = d.id_uz""",
    "obcy": """
SELECT w.id_uz, w.id_grupy, CASE WHEN g.id_grupy IS NULL THEN 'no_group' WHEN g.na_zaproszenie THEN 'invite_only' END AS powod
FROM (SELECT id_uz, id_grupy FROM wizyty EXCEPT SELECT id_uz, id_grupy FROM dostep_grupa) w
LEFT JOIN grupa_quizowa g ON g.id_grupy = w.id_grupy""",
    "przelaczane": """
SELECT r.id_pyt, r.n, p.ukryty, v.poprawne FROM (SELECT id_pyt, count(*) AS n FROM przelaczenia GROUP BY id_pyt) r
LEFT JOIN pytanie p ON p.id_pyt = r.id_pyt LEFT JOIN waznosc v ON v.id_pyt = r.id_pyt""",
    "pytania_zmienione": """
SELECT p.id_pyt, c.nr, c.tresc, c.id_typu, c.pkt, c.id_kategorii, p.id_typu AS typ_przed,
  nullif(concat_ws(',', CASE WHEN trim(coalesce(c.tresc, p.tresc)) = '' THEN 'tresc_pusta' END,
                   CASE WHEN coalesce(c.pkt, p.pkt) < 0 THEN 'pkt_ujemne' END), '') AS powod
FROM pytanie p JOIN zmiany_pytan c ON c.id_pyt = p.id_pyt""",
    "pytania_stany": """
SELECT id_pyt, nr, tresc, pkt, id_kategorii, id_typu, coalesce(last_value(id_typu IGNORE NULLS) OVER (
  PARTITION BY id_pyt ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), typ_przed) AS typ_po
FROM pytania_zmienione WHERE powod IS NULL""",
    "pytania_nowe": """
SELECT s.id_pyt, arg_max(tresc, nr) FILTER (WHERE tresc IS NOT NULL) AS tresc, arg_max(pkt, nr) FILTER (WHERE pkt IS NOT NULL) AS pkt,
  arg_max(id_kategorii, nr) FILTER (WHERE id_kategorii IS NOT NULL) AS id_kategorii,
  arg_max(s.id_typu, nr) FILTER (WHERE s.id_typu IS NOT NULL) AS id_typu,
  bool_and(coalesce(n.ile, 0) >= t.liczba_odp AND (t.wielokrotnego_wyboru OR coalesce(n.pelne, 0) > 0)) AS zawsze_poprawne
FROM pytania_stany s JOIN typ t ON t.id_typu = s.typ_po
LEFT JOIN (SELECT id_pyt, count(*) AS ile, count(*) FILTER (WHERE poziom_poprawnosci = 100) AS pelne
           FROM odpowiedz_wzorcowa GROUP BY 1) n ON n.id_pyt = s.id_pyt GROUP BY s.id_pyt""",
    "odpowiedzi_reguly": """
SELECT c.*, p.id_pyt IS NOT NULL AS znane, nullif(concat_ws(',',
    CASE WHEN c.op = 'create' AND c.tresc_odp = '' THEN 'tresc_odp_pusta' END,
    CASE WHEN c.poziom_poprawnosci NOT BETWEEN 0 AND 100 THEN 'poziom_poza_zakresem' END,
    CASE WHEN t.wielokrotnego_wyboru AND c.poziom_poprawnosci NOT IN (0, 100) THEN 'poziom_wielokrotny' END), '') AS zle,
  (SELECT count(*) FROM odpowiedz_wzorcowa w WHERE w.id_pyt = c.id_pyt AND w.tresc_odp = c.tresc_odp) AS bylo
FROM zmiany_odpowiedzi c LEFT JOIN pytanie p ON p.id_pyt = c.id_pyt LEFT JOIN typ t ON t.id_typu = p.id_typu""",
    # one row per request in order: rows of the text that are left before it, and how many were taken away
    "odpowiedzi_sumy": """
SELECT *, bylo + sum(krok) OVER w AS suma FROM (
  SELECT *, CASE WHEN NOT znane THEN 0 WHEN op = 'create' AND zle IS NULL THEN 1 WHEN op = 'delete' THEN -1 ELSE 0 END AS krok
  FROM odpowiedzi_reguly) WINDOW w AS (PARTITION BY id_pyt, tresc_odp ORDER BY nr)""",
    "odpowiedzi_kolejka": """
SELECT *, coalesce(lag(dno) OVER w, 0) AS dno_przed, sum((krok = -1)::INT) OVER w + dno AS usuniete, sum((krok = 1)::INT) OVER w AS dodane
FROM (SELECT *, least(0, min(suma) OVER (PARTITION BY id_pyt, tresc_odp ORDER BY nr)) AS dno FROM odpowiedzi_sumy)
WINDOW w AS (PARTITION BY id_pyt, tresc_odp ORDER BY nr)""",
    "odpowiedzi_ocenione": """
SELECT *, CASE WHEN NOT znane THEN 'no_question'
  WHEN op <> 'create' AND suma - krok - dno_przed <= 0 THEN 'no_template' WHEN op <> 'delete' THEN zle END AS powod
FROM odpowiedzi_kolejka""",
    "odpowiedzi_wiersze": """
SELECT id_odp_w, id_pyt, tresc_odp, poziom_poprawnosci, komentarz, ost_modyfikacja,
  row_number() OVER (PARTITION BY id_pyt, tresc_odp ORDER BY id_odp_w) AS miejsce FROM odpowiedz_wzorcowa
UNION ALL
SELECT (SELECT max(id_odp_w) FROM odpowiedz_wzorcowa) + row_number() OVER (ORDER BY nr), id_pyt, tresc_odp,
  poziom_poprawnosci, komentarz, kiedy, bylo + dodane FROM odpowiedzi_ocenione WHERE op = 'create' AND powod IS NULL""",
    "odpowiedzi_edycje": """
SELECT id_pyt, tresc_odp, usuniete + 1 AS miejsce, arg_max(kiedy, nr) AS kiedy, arg_max(komentarz, nr) AS komentarz,
  arg_max(poziom_poprawnosci, nr) AS poziom_poprawnosci
FROM odpowiedzi_ocenione WHERE op = 'update' AND powod IS NULL GROUP BY ALL""",
    "ruchy_wlascicieli": """
SELECT c.*, CASE WHEN q.id_quizu IS NULL THEN 'no_quiz' WHEN q.id_grupy <> 0 THEN 'not_in_limbo' END AS powod
FROM zmiany_wlascicieli c LEFT JOIN quiz q ON q.id_quizu = c.id_quizu""",
    "ruchy_wstepne": """
SELECT c.*, CASE WHEN g.id_grupy IS NULL THEN 'no_group' WHEN q.id_quizu IS NULL THEN 'no_quiz'
                 WHEN q.id_grupy <> 0 THEN 'not_in_limbo' END AS wstepny
FROM przeniesienia c LEFT JOIN quiz q ON q.id_quizu = c.id_quizu
LEFT JOIN grupa_quizowa g ON g.id_grupy = c.id_grupy""",
    "cele": """
SELECT id_quizu, id_grupy AS cel, nr AS kiedy FROM ruchy_wstepne WHERE wstepny IS NULL AND id_grupy <> 0
QUALIFY row_number() OVER (PARTITION BY id_quizu ORDER BY nr) = 1""",
    "ruchy_grup": """
SELECT r.nr, r.id_quizu, r.id_grupy, coalesce(wstepny, CASE WHEN r.nr > c.kiedy THEN 'not_in_limbo' END) AS powod
FROM ruchy_wstepne r LEFT JOIN cele c ON c.id_quizu = r.id_quizu""",
    "quizy_po_ruchu": """
SELECT q.id_quizu, q.id_wlasciciela, q.nazwa, coalesce(c.cel, q.id_grupy) AS id_grupy, q.limit_podejsc,
  q.limit_czasowy, q.data_utworzenia, q.ukryty FROM quiz q LEFT JOIN cele c USING (id_quizu)""",
    "grupy_sprawdzone": """
SELECT n.*, CASE WHEN coalesce(u.ranga, '') NOT IN ('teacher', 'moderator', 'administrator') THEN 'no_privilege'
                 WHEN trim(n.nazwa) = '' THEN 'nazwa_pusta' WHEN length(n.nazwa) > 60 THEN 'nazwa_za_dluga' END AS powod
FROM nowe_grupy n LEFT JOIN uzytkownik u ON u.id_uz = n.id_wlasciciela""",
    "grupy_ocenione": """
SELECT s.nr, s.id_wlasciciela, s.nazwa, s.na_zaproszenie, s.haslo, CASE
  WHEN s.powod IS NOT NULL THEN s.powod
  WHEN s.nazwa IN (SELECT nazwa FROM grupa_quizowa)
    OR s.nr > (SELECT min(o.nr) FROM grupy_sprawdzone o WHERE o.powod IS NULL AND o.nazwa = s.nazwa)
  THEN 'name_taken' END AS powod
FROM grupy_sprawdzone s""",
    "nowi_sprawdzeni": f"""
SELECT *, nullif(concat_ws(',', CASE WHEN NOT regexp_matches(email, '{EMAIL}') THEN 'email_format' END,
  CASE WHEN trim(nazwa_uz) = '' THEN 'nazwa_uz_pusta' END, CASE WHEN length(nazwa_uz) > 30 THEN 'nazwa_uz_za_dluga' END,
  CASE WHEN length(login) > 15 THEN 'login_za_dlugi' END), '') AS zle FROM nowi_uzytkownicy""",
    "nowi_ocenieni": """
SELECT z.*, nullif(concat_ws(',', zle, CASE WHEN {nazwa_uz} THEN 'nazwa_uz_zajete' END,
  CASE WHEN {login} THEN 'login_zajete' END, CASE WHEN {email} THEN 'email_zajete' END), '') AS powod
FROM nowi_sprawdzeni z""".format(**{f: f"""(z.{f} IN (SELECT {f} FROM uzytkownik)
  OR coalesce(z.nr > (SELECT min(o.nr) FROM nowi_sprawdzeni o WHERE o.zle IS NULL AND o.{f} = z.{f}), false))"""
                                    for f in ("nazwa_uz", "login", "email")}),
    "pytania_usuwane": """
SELECT id_pyt FROM pytanie WHERE id_quizu IN (SELECT id_quizu FROM quizy_do_usuniecia)
UNION SELECT id_pyt FROM pytania_do_usuniecia""",
    "profile_zmienione": f"""
SELECT c.nr, c.id_uz, c.nazwa_uz, c.login, c.email,
  nullif(concat_ws(',', CASE WHEN NOT regexp_matches(coalesce(c.email, u.email), '{EMAIL}') THEN 'email_format' END,
                   CASE WHEN length(coalesce(c.login, u.login)) > 15 THEN 'login_za_dlugi' END), '') AS zle
FROM zmiany_profili c JOIN uzytkownik u ON u.id_uz = c.id_uz""",
    "profile_ocenione": """
SELECT z.*, nullif(concat_ws(',', zle, CASE WHEN {nazwa_uz} THEN 'nazwa_uz_zajete' END,
  CASE WHEN {login} THEN 'login_zajete' END, CASE WHEN {email} THEN 'email_zajete' END), '') AS powod
FROM profile_zmienione z""".format(**{f: f"""(EXISTS (SELECT 1 FROM uzytkownik o WHERE o.{f} = z.{f} AND o.id_uz <> z.id_uz)
  OR z.{f} NOT IN (SELECT {f} FROM uzytkownik)
     AND (SELECT arg_min(o.id_uz, o.nr) FROM profile_zmienione o WHERE o.zle IS NULL AND o.{f} = z.{f} AND o.nr < z.nr) <> z.id_uz)"""
                                      for f in ("nazwa_uz", "login", "email")}),
    "linie": r"""
SELECT doc_id, unnest(l) AS linia, generate_subscripts(l, 1) - 1 AS nr
FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '\r?\n\z', ''), '\r?\n') AS l
      FROM documents WHERE length(text) > 0)""",
    "bloki": f"""
SELECT doc_id AS zrodlo, nr // 5 AS blok,
  max(trim(linia, {SPACES})) FILTER (WHERE nr % 5 = 0) AS pytanie,
  list(trim(linia, {SPACES}) ORDER BY nr) FILTER (WHERE nr % 5 > 0) AS odpowiedzi
FROM linie GROUP BY ALL""",
    "bloki_testow": _two_lines("benchmark", "item_id"),
    "bloki_rozmow": _two_lines("conversations", "conv_id * 1000 + turn"),
    "zestawy": """
SELECT 1 AS z, zrodlo, blok, pytanie, odpowiedzi, 40 AS quizy, 101 AS q0, 4 AS ile, CAST(3 AS BIGINT) AS id_typu FROM bloki
UNION ALL SELECT 2, zrodlo, blok, pytanie, odpowiedzi, 7, 141, 1, 11 FROM bloki_testow
UNION ALL SELECT 3, zrodlo, blok, pytanie, odpowiedzi, 9, 148, 1, 11 FROM bloki_rozmow""",
    "zestawy_nr": """
SELECT *, row_number() OVER (ORDER BY z, zrodlo, blok) - 1 AS i, row_number() OVER (PARTITION BY z ORDER BY zrodlo, blok) - 1 AS w,
  coalesce(sum(ile) OVER (ORDER BY z, zrodlo, blok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o0 FROM zestawy""",
    "bloki_nr": "SELECT *, row_number() OVER (ORDER BY zrodlo, blok) - 1 AS i FROM bloki",
}

GONE_CATEGORIES = "SELECT id_podkategorii FROM podkategoria WHERE id_nadkategorii = 4"
QUIZ = "id_quizu, id_wlasciciela, nazwa, id_grupy, limit_podejsc, limit_czasowy, data_utworzenia, ukryty"
QUESTION = "id_pyt, tresc, id_typu, id_autora, pkt, id_quizu, id_kategorii, ukryty"

SQL = {
    # scoring and rankings
    "question_scores": "SELECT * FROM punkty",
    "question_page": f"""
SELECT id_uz, id_pyt, data_wyslania, '(' || zdobyte_pkt || ' / ' || max_pkt || ' punktów)' AS etykieta,
  {_band("zdobyte_pkt", "max_pkt")} AS ocena FROM punkty""",
    "attempt_history": f"""
SELECT *, CAST(trunc(zdobyte_pkt) AS INTEGER) AS zdobyte_calk, CAST(trunc(max_pkt) AS INTEGER) AS max_calk,
  {_band("trunc(zdobyte_pkt)", "trunc(max_pkt)")} AS ocena FROM podejscia""",
    "recompute_ranking": "SELECT * FROM ranking",
    "recompute_ranking_last": """
SELECT b.id_uz, q.id_grupy, round(sum(b.m), 6) AS pkt
FROM (SELECT id_uz, id_quizu, arg_max(zdobyte_pkt, data_wyslania) AS m FROM podejscia GROUP BY ALL) b
JOIN quiz q USING (id_quizu) WHERE q.id_grupy <> 0 GROUP BY ALL""",
    "recompute_ranking_sum": """
SELECT p.id_uz, q.id_grupy, round(sum(p.zdobyte_pkt), 6) AS pkt
FROM podejscia p JOIN quiz q USING (id_quizu) GROUP BY ALL""",
    "recompute_group_ranking": """
SELECT r.id_uz, r.id_grupy, CASE WHEN g.na_zaproszenie THEN r.pkt ELSE r.pkt + 1 END AS pkt
FROM ranking r JOIN grupa_quizowa g USING (id_grupy)""",
    "leaderboard": f"""
SELECT r.id_grupy, r.place, r.id_uz, u.nazwa_uz, r.pkt
FROM (SELECT *, row_number() OVER (PARTITION BY id_grupy ORDER BY pkt DESC, id_uz) AS place FROM ranking) r
JOIN uzytkownik u ON u.id_uz = r.id_uz WHERE {may("r.id_uz", "r.id_grupy", 1)}""",
    "leaderboard_raw": "SELECT r.id_grupy, r.id_uz, u.nazwa_uz, r.pkt FROM ranking r JOIN uzytkownik u USING (id_uz)",
    "attempt_limit_status": """
SELECT c.id_uz, c.id_quizu, c.podejscia, q.limit_podejsc,
  greatest(q.limit_podejsc - c.podejscia, CASE WHEN q.limit_podejsc IS NOT NULL THEN 0 END) AS pozostalo,
  coalesce(c.podejscia >= q.limit_podejsc, false) AS wyczerpane
FROM (SELECT o.id_uz, p.id_quizu, count(DISTINCT o.data_wyslania) AS podejscia
      FROM odpowiedz_uzytkownika o JOIN pytanie p USING (id_pyt) GROUP BY ALL) c JOIN quiz q USING (id_quizu)""",
    # sampling and submissions
    "sample_options": """
SELECT id_uz, id_pyt, place, id_odp_w, tresc_odp, poziom_poprawnosci, komentarz FROM wylosowane WHERE NOT blad""",
    "sample_options_errors": """
SELECT DISTINCT a.id_uz, p.id_pyt FROM attempts a JOIN pytanie p USING (id_quizu)
WHERE NOT p.ukryty AND p.id_pyt NOT IN (SELECT id_pyt FROM odpowiedz_wzorcowa WHERE poziom_poprawnosci = 100)""",
    "gate_submissions": "SELECT id_uz, id_grupy, id_quizu, data_wyslania FROM przyjete",
    "gate_submissions_rejects": """
SELECT id_uz, id_grupy, id_quizu, data_wyslania, powod FROM ocenione WHERE powod IS NOT NULL""",
    "gate_submissions_members": """
SELECT id_grupy, id_uz, prawa_dost FROM dostep_grupa
UNION ALL SELECT DISTINCT id_grupy, id_uz, '1100000000000000' FROM ocenione o
WHERE id_grupy IN (SELECT id_grupy FROM grupa_quizowa WHERE NOT na_zaproszenie)
  AND NOT EXISTS (SELECT 1 FROM dostep_grupa d WHERE d.id_uz = o.id_uz AND d.id_grupy = o.id_grupy)""",
    "refused_entries": """
SELECT * FROM (
  SELECT a.id_uz, a.id_quizu, a.data_wyslania, a.id_quizu * 10 + e.k AS id_pyt, CASE
    WHEN p.id_pyt IS NULL THEN 'no_question' WHEN p.id_quizu <> a.id_quizu THEN 'other_quiz'
    WHEN p.ukryty THEN 'hidden_question' END AS powod
  FROM attempts a JOIN wpisy e USING (o_orderkey) LEFT JOIN pytanie p ON p.id_pyt = a.id_quizu * 10 + e.k)
WHERE powod IS NOT NULL""",
    "expand_submissions": "SELECT * FROM wyslane",
    "expand_submissions_rejects": """
SELECT a.id_uz, p.id_pyt, a.data_wyslania FROM przyjete a JOIN pytanie p USING (id_quizu)
WHERE NOT p.ukryty AND p.id_pyt NOT IN (SELECT id_pyt FROM odpowiedz_wzorcowa WHERE poziom_poprawnosci = 100)""",
    "submission_comments": """
SELECT id_uz, id_pyt, data_wyslania,
  'Komentarz: ' || nullif(string_agg(komentarz, '' ORDER BY place) FILTER (WHERE zaznaczona), '') AS komentarz
FROM pokazane GROUP BY ALL""",
    "answer_ids": """
SELECT row_number() OVER (ORDER BY data_wyslania, id_uz, id_pyt, tresc_odp, zaznaczona)
    + (SELECT max(id_odp_u) FROM odpowiedz_uzytkownika) AS id_odp_u,
  id_uz, id_pyt, data_wyslania, tresc_odp, zaznaczona FROM wyslane""",
    # access
    "has_privileges_edit": f"SELECT id_uz, id_grupy, {may('p.id_uz', 'p.id_grupy', 4)} AS dozwolone FROM pary p",
    "has_privileges_both": f"SELECT id_uz, id_grupy, {may('p.id_uz', 'p.id_grupy', 1, 3)} AS dozwolone FROM pary p",
    "has_privileges_unknown": f"SELECT id_uz, id_grupy, {may('p.id_uz', 'p.id_grupy', 16)} AS dozwolone FROM pary p",
    "has_privileges_access": f"SELECT id_uz, id_grupy, {may('p.id_uz', 'p.id_grupy')} AS dozwolone FROM pary p",
    "privilege_matrix": """
SELECT id_grupy, id_uz, prawa_dost[1] = '1' AS participation_in_quizzes,
  prawa_dost[2] = '1' AS participation_in_discussions, prawa_dost[3] = '1' AS creation_of_quizzes,
  prawa_dost[4] = '1' AS editing_and_deleting_quizzes, prawa_dost[5] = '1' AS editing_and_deleting_discussions,
  true AS access_to_group FROM dostep_grupa""",
    "quiz_privilege_check": f"""
SELECT *, NOT dozwolone AND akcja <> 'create' AS zablokowane FROM (
  SELECT nr, id_uz, id_grupy, id_quizu, akcja, CASE akcja
    WHEN 'play' THEN {may("p.id_uz", "p.id_grupy", 1)}
    WHEN 'create' THEN {may("p.id_uz", "p.id_grupy", 3)}
    ELSE {may("p.id_uz", "p.id_grupy", 4)} END AS dozwolone
  FROM prosby_quiz p)""",
    "removal_check": "SELECT nr, id_aktora, id_uz, id_grupy, werdykt FROM werdykty",
    "profile_edit_check": """
SELECT e.id_aktora, e.id_uz, CASE WHEN u.id_uz IS NULL THEN 'no_user'
  WHEN e.id_aktora = e.id_uz OR a.ranga IN ('moderator', 'administrator') THEN 'ok' ELSE 'no_privilege' END AS werdykt
FROM edycje_profilu e LEFT JOIN uzytkownik u ON u.id_uz = e.id_uz LEFT JOIN uzytkownik a ON a.id_uz = e.id_aktora""",
    "limbo_access": "SELECT id_uz, ranga IN ('moderator', 'administrator') AS dozwolone FROM uzytkownik",
    "user_roles": """
SELECT id_uz, ranga = 'user' AS zwykly, ranga = 'teacher' AS nauczyciel, ranga = 'moderator' AS moderator,
  ranga = 'administrator' AS administrator, ranga IN ('moderator', 'administrator') AS superuser,
  ranga <> 'user' AS moze_tworzyc_grupy FROM uzytkownik""",
    # listings and checks
    "lookup_by_key": "SELECT id_quizu, nazwa, id_grupy FROM quiz WHERE id_quizu IN (SELECT id_quizu FROM klucze)",
    "lookup_missing": "SELECT id_quizu FROM klucze EXCEPT SELECT id_quizu FROM quiz",
    "visible_questions": f"SELECT {QUESTION} FROM pytanie WHERE NOT ukryty",
    "active_quizzes": f"SELECT {QUIZ} FROM quiz WHERE NOT ukryty",
    "quiz_listing": f"""
SELECT * FROM (SELECT r.id_uz, q.id_grupy, q.id_quizu, q.nazwa, NOT q.ukryty AS moze_grac,
  {may("r.id_uz", "q.id_grupy", 4)} AS moze_edytowac FROM gracze r JOIN quiz q USING (id_quizu))
WHERE moze_grac OR moze_edytowac""",
    "visible_groups": "SELECT id_uz, id_grupy, place FROM widoczne JOIN pary USING (id_uz, id_grupy)",
    "visible_groups_documented": "SELECT id_uz, id_grupy, place FROM widoczne_dok JOIN pary USING (id_uz, id_grupy)",
    "group_overview": """
SELECT w.id_uz, w.id_grupy, w.place, k.nazwa, lu.uzytkownicy, lq.quizy, k.na_zaproszenie, k.chroniona_haslem,
  d.id_uz IS NOT NULL AS zapisany, d.id_uz IS NOT NULL AND w.id_uz <> g.id_wlasciciela AS moze_sie_wypisac
FROM widoczne w JOIN pary p ON p.id_uz = w.id_uz AND p.id_grupy = w.id_grupy
JOIN karty k ON k.id_grupy = w.id_grupy JOIN grupa_quizowa g ON g.id_grupy = w.id_grupy
JOIN liczby_uz lu ON lu.id_grupy = w.id_grupy JOIN liczby_quiz lq ON lq.id_grupy = w.id_grupy
LEFT JOIN dostep_grupa d ON d.id_uz = w.id_uz AND d.id_grupy = w.id_grupy""",
    "groups_except_limbo": """
SELECT g.id_grupy, g.nazwa, g.id_wlasciciela, u.nazwa_uz AS wlasciciel
FROM grupa_quizowa g LEFT JOIN uzytkownik u ON u.id_uz = g.id_wlasciciela WHERE g.id_grupy > 0""",
    "limbo_quizzes": "SELECT id_quizu, nazwa FROM quiz WHERE id_grupy = 0",
    "moderators": """
SELECT id_uz, nazwa_uz, ranga, row_number() OVER (ORDER BY id_uz) AS place
FROM uzytkownik WHERE id_uz <> 0 AND ranga IN ('moderator', 'administrator')""",
    "ownership_candidates": """
SELECT p.id_quizu, u.id_uz, u.nazwa_uz, u.ranga FROM propozycje p JOIN quiz q USING (id_quizu)
JOIN uzytkownik u ON u.id_uz = p.id_uz WHERE u.id_uz <> 0 AND u.id_uz <> q.id_wlasciciela""",
    "check_containment": """
SELECT z.id_grupy, z.id_quizu, z.id_pyt, CASE
  WHEN z.id_grupy NOT IN (SELECT id_grupy FROM grupa_quizowa) THEN 'no_group'
  WHEN q.id_quizu IS NULL THEN 'no_quiz' WHEN q.id_grupy <> z.id_grupy THEN 'quiz_not_in_group'
  WHEN z.id_pyt IS NULL THEN 'ok' WHEN p.id_pyt IS NULL THEN 'no_question'
  WHEN p.id_quizu <> z.id_quizu THEN 'question_not_in_quiz' ELSE 'ok' END AS werdykt
FROM zawieranie z LEFT JOIN quiz q ON q.id_quizu = z.id_quizu LEFT JOIN pytanie p ON p.id_pyt = z.id_pyt""",
    "template_lookup": """
SELECT s.id_pyt, s.tresc_odp, w.id_odp_w, w.poziom_poprawnosci FROM szukane s JOIN odpowiedz_wzorcowa w
  ON w.id_pyt = s.id_pyt AND w.tresc_odp = s.tresc_odp
QUALIFY row_number() OVER (PARTITION BY s.id_pyt, s.tresc_odp ORDER BY w.id_odp_w) = 1""",
    "type_by_shape": """
SELECT p.id_pyt, t.wielokrotnego_wyboru, v.odpowiedzi AS liczba_odp, min(f.id_typu) AS id_typu
FROM pytanie p JOIN typ t ON t.id_typu = p.id_typu JOIN waznosc v ON v.id_pyt = p.id_pyt
JOIN typ f ON f.liczba_odp = v.odpowiedzi AND f.wielokrotnego_wyboru = t.wielokrotnego_wyboru GROUP BY ALL""",
    "group_card": "SELECT * FROM karty",
    "quiz_header": "SELECT id_quizu, nazwa, data_utworzenia, limit_czasowy, limit_podejsc FROM quiz",
    "choice_lists": """
SELECT 'typ' AS lista, nazwa, id_typu AS id FROM typ UNION ALL SELECT 'kategoria', nazwa, id_kategorii FROM kategoria""",
    "question_editability": """
SELECT e.id_uz, e.id_pyt, e.id_uz = p.id_autora AS moze_edytowac FROM edycje_pytan e JOIN pytanie p USING (id_pyt)""",
    "first_row": "SELECT id_kategorii, nazwa FROM kategoria WHERE id_kategorii = (SELECT min(id_kategorii) FROM kategoria)",
    # associations
    "questions_enriched": """
SELECT p.id_grupy, p.id_quizu, p.id_kategorii, p.id_typu, p.id_pyt, p.tresc, p.pkt, p.ukryty, t.nazwa AS typ,
  t.liczba_odp, t.wielokrotnego_wyboru, k.nazwa AS kategoria, p.nazwa AS quiz, g.nazwa AS grupa
FROM (SELECT p.*, q.id_grupy, q.nazwa FROM pytanie p JOIN quiz q USING (id_quizu)) p JOIN typ t ON t.id_typu = p.id_typu
JOIN kategoria k ON k.id_kategorii = p.id_kategorii JOIN grupa_quizowa g ON g.id_grupy = p.id_grupy""",
    "question_options": """
SELECT p.id_pyt, p.id_quizu, p.id_typu, w.id_odp_w, w.tresc_odp, w.poziom_poprawnosci
FROM pytanie p LEFT JOIN odpowiedz_wzorcowa w USING (id_pyt)""",
    "question_user_answers": """
SELECT o.*, p.id_quizu, p.pkt FROM odpowiedz_uzytkownika o JOIN pytanie p USING (id_pyt)""",
    "quiz_contents": """
SELECT q.id_quizu, q.nazwa AS quiz, p.id_pyt, p.tresc, p.ukryty FROM quiz q JOIN pytanie p USING (id_quizu)""",
    "group_members": "SELECT * FROM czlonkowie",
    "member_page": f"""
SELECT w.nr, w.id_aktora AS id_widza, w.id_grupy, w.id_uz, c.place, c.nazwa_uz,
  c.usuwalny AND {may("w.id_aktora", "w.id_grupy", 16)} AS przycisk_usun
FROM wypisy w JOIN czlonkowie c ON c.id_grupy = w.id_grupy AND c.id_uz = w.id_uz""",
    "groups_with_owner": """
SELECT g.id_grupy, g.nazwa, g.id_wlasciciela, u.nazwa_uz AS wlasciciel
FROM grupa_quizowa g LEFT JOIN uzytkownik u ON u.id_uz = g.id_wlasciciela""",
    "ranking_with_user": "SELECT r.id_grupy, r.id_uz, u.nazwa_uz, r.pkt FROM ranking r JOIN uzytkownik u USING (id_uz)",
    "owned_objects": """
SELECT u.id_uz, u.nazwa_uz, 'quiz' AS rodzaj, q.id_quizu AS id, q.nazwa
FROM uzytkownik u JOIN quiz q ON q.id_wlasciciela = u.id_uz
UNION ALL SELECT u.id_uz, u.nazwa_uz, 'grupa', g.id_grupy, g.nazwa
FROM uzytkownik u JOIN grupa_quizowa g ON g.id_wlasciciela = u.id_uz""",
    "is_enrolled": """
SELECT w.id_uz, w.id_grupy, EXISTS (SELECT 1 FROM dostep_grupa d WHERE d.id_uz = w.id_uz AND d.id_grupy = w.id_grupy)
  AS zapisany FROM wizyty w""",
    "enrolled": "SELECT * FROM wizyty WHERE (id_uz, id_grupy) IN (SELECT (id_uz, id_grupy) FROM dostep_grupa)",
    "not_enrolled": "SELECT * FROM wizyty WHERE (id_uz, id_grupy) NOT IN (SELECT (id_uz, id_grupy) FROM dostep_grupa)",
    # counts
    "member_counts": "SELECT * FROM liczby_uz",
    "active_quiz_counts": "SELECT * FROM liczby_quiz",
    "question_validity": "SELECT * FROM waznosc",
    # column functions
    "access_bits": """
SELECT id_grupy, id_uz, CAST(list_sum([(prawa_dost[i] = '1')::INT * (1 << (16 - i)) FOR i IN range(1, 17)]) AS INTEGER)
    AS prawa, prawa_dost[1] = '1' AND prawa_dost[5] = '1' AS oba FROM dostep_grupa""",
    "text_functions": rf"""
SELECT doc_id, coalesce(TRY_CAST(nullif(regexp_extract(text, '^\s*([+-]?\d+)', 1), '') AS BIGINT), 0) AS liczba,
  md5(trim(text, {SPACES})) AS obciety, NOT regexp_matches(text, '\S') AS pusty, regexp_matches(text, '\S') AS obecny,
  regexp_matches(text, '{EMAIL}') AS email FROM documents""",
    "order_functions": """
SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS BIGINT) AS priorytet,
  strftime(o_orderdate + to_milliseconds(o_orderkey), '%Y-%m-%d %H:%M:%S.%g') AS czas,
  o_orderkey // 4 AS blok, o_orderkey % 4 AS miejsce FROM orders""",
    "time_round_trip": "SELECT o_orderkey, data_wyslania FROM attempts",
    "submission_membership": """
SELECT a.id_uz, a.data_wyslania, a.id_quizu * 10 + e.k AS id_pyt, coalesce(list_contains(e.chosen, 'A'), false) AS wybrano_a,
  coalesce(e.open_text, 'nil') AS tekst FROM attempts a LEFT JOIN wpisy e USING (o_orderkey)""",
    "question_kinds": """
SELECT id_pyt, CASE WHEN id_typu = 11 THEN 'open' WHEN id_typu > 5 THEN 'multi' ELSE 'single' END AS rodzaj,
  'Pytanie ' || id_pyt || ': ' || tresc AS opis FROM pytanie""",
    # table changes
    "enroll_visits": """
SELECT id_grupy, id_uz, prawa_dost FROM dostep_grupa
UNION ALL SELECT id_grupy, id_uz, '1100000000000000' FROM obcy WHERE powod IS NULL""",
    "enroll_visits_rejects": "SELECT * FROM obcy WHERE powod IS NOT NULL",
    "remove_members": """
SELECT id_grupy, id_uz, prawa_dost FROM dostep_grupa
WHERE (id_uz, id_grupy) NOT IN (SELECT (id_uz, id_grupy) FROM werdykty WHERE werdykt = 'ok')""",
    "remove_members_rejects": "SELECT nr, id_aktora, id_uz, id_grupy, werdykt FROM werdykty WHERE werdykt <> 'ok'",
    "set_quiz_visibility": """
SELECT q.id_quizu, q.id_wlasciciela, q.nazwa, q.id_grupy, q.limit_podejsc, q.limit_czasowy, q.data_utworzenia,
  coalesce(c.ukryty, q.ukryty) AS ukryty
FROM quiz q LEFT JOIN (SELECT id_quizu, arg_max(ukryty, nr) AS ukryty FROM zmiany_widocznosci GROUP BY 1) c USING (id_quizu)""",
    "set_quiz_visibility_rejects": """
SELECT nr, id_quizu, 'no_quiz' AS powod FROM zmiany_widocznosci WHERE id_quizu NOT IN (SELECT id_quizu FROM quiz)""",
    "toggle_questions": """
SELECT p.id_pyt, p.tresc, p.id_typu, p.id_autora, p.pkt, p.id_quizu, p.id_kategorii,
  CASE WHEN t.n IS NULL THEN p.ukryty WHEN NOT t.poprawne THEN true
       WHEN t.n % 2 = 1 THEN NOT p.ukryty ELSE p.ukryty END AS ukryty
FROM pytanie p LEFT JOIN przelaczane t ON t.id_pyt = p.id_pyt""",
    "toggle_questions_rejects": """
SELECT id_pyt, 'no_question' AS powod, n AS odmowy FROM przelaczane WHERE ukryty IS NULL
UNION ALL SELECT id_pyt, 'invalid', n - (NOT ukryty)::INT FROM przelaczane
WHERE ukryty IS NOT NULL AND NOT poprawne AND n - (NOT ukryty)::INT > 0""",
    "update_questions": """
SELECT p.id_pyt, coalesce(n.tresc, p.tresc) AS tresc, coalesce(n.id_typu, p.id_typu) AS id_typu, p.id_autora,
  coalesce(n.pkt, p.pkt) AS pkt, p.id_quizu, coalesce(n.id_kategorii, p.id_kategorii) AS id_kategorii,
  p.ukryty OR NOT coalesce(n.zawsze_poprawne, true) AS ukryty
FROM pytanie p LEFT JOIN pytania_nowe n ON n.id_pyt = p.id_pyt""",
    "update_questions_rejects": """
SELECT nr, id_pyt, powod FROM pytania_zmienione WHERE powod IS NOT NULL
UNION ALL SELECT nr, id_pyt, 'no_question' FROM zmiany_pytan WHERE id_pyt NOT IN (SELECT id_pyt FROM pytanie)""",
    "apply_option_changes": """
SELECT w.id_odp_w, w.id_pyt, w.tresc_odp, coalesce(e.poziom_poprawnosci, w.poziom_poprawnosci) AS poziom_poprawnosci,
  coalesce(e.komentarz, w.komentarz) AS komentarz, coalesce(e.kiedy, w.ost_modyfikacja) AS ost_modyfikacja
FROM odpowiedzi_wiersze w
LEFT JOIN odpowiedzi_edycje e ON e.id_pyt = w.id_pyt AND e.tresc_odp = w.tresc_odp AND e.miejsce = w.miejsce
LEFT JOIN (SELECT id_pyt, tresc_odp, max(usuniete) AS glowa FROM odpowiedzi_ocenione GROUP BY ALL) g
  ON g.id_pyt = w.id_pyt AND g.tresc_odp = w.tresc_odp WHERE w.miejsce > coalesce(g.glowa, 0)""",
    "apply_option_changes_rejects": """
SELECT nr, op, id_pyt, tresc_odp, powod FROM odpowiedzi_ocenione WHERE powod IS NOT NULL""",
    "transfer_ownership": """
SELECT q.id_quizu, coalesce(c.w, q.id_wlasciciela) AS id_wlasciciela, q.nazwa, q.id_grupy, q.limit_podejsc,
  q.limit_czasowy, q.data_utworzenia, q.ukryty
FROM quiz q LEFT JOIN (SELECT id_quizu, arg_max(id_wlasciciela, nr) AS w FROM ruchy_wlascicieli
                       WHERE powod IS NULL GROUP BY 1) c USING (id_quizu)""",
    "transfer_ownership_rejects": "SELECT nr, id_quizu, powod FROM ruchy_wlascicieli WHERE powod IS NOT NULL",
    "transfer_to_group": "SELECT * FROM quizy_po_ruchu",
    "transfer_to_group_ranking": """
SELECT id_uz, id_grupy, pkt FROM ranking WHERE id_grupy NOT IN (SELECT cel FROM cele)
UNION ALL SELECT b.id_uz, q.id_grupy, round(sum(b.m), 6)
FROM (SELECT id_uz, id_quizu, max(zdobyte_pkt) AS m FROM podejscia GROUP BY ALL) b
JOIN quizy_po_ruchu q USING (id_quizu) WHERE q.id_grupy IN (SELECT cel FROM cele) GROUP BY ALL""",
    "transfer_to_group_rejects": "SELECT nr, id_quizu, id_grupy, powod FROM ruchy_grup WHERE powod IS NOT NULL",
    "delete_quiz_answers": """
SELECT * FROM odpowiedz_uzytkownika WHERE id_pyt NOT IN (SELECT p.id_pyt FROM pytanie p
  WHERE p.id_quizu IN (SELECT id_quizu FROM ruchy_wlascicieli WHERE powod IS NULL))""",
    "delete_quiz_answers_rejects": "SELECT nr, id_quizu, powod FROM ruchy_wlascicieli WHERE powod IS NOT NULL",
    "create_quizzes": f"""
SELECT {QUIZ} FROM quiz UNION ALL
SELECT (SELECT max(id_quizu) FROM quiz) + row_number() OVER (ORDER BY nr), id_wlasciciela, nazwa,
  coalesce(id_grupy, 1), NULL, NULL, kiedy, false FROM nowe_quizy""",
    "create_questions": f"""
SELECT {QUESTION} FROM pytanie UNION ALL
SELECT (SELECT max(id_pyt) FROM pytanie) + row_number() OVER (ORDER BY nr),
  'Nowe pytanie z ' || strftime(kiedy, '%Y-%m-%d %H:%M:%S'), 1, id_autora, 1.0, id_quizu, 1, true FROM nowe_pytania""",
    "create_groups": """
SELECT id_grupy, id_wlasciciela, nazwa, na_zaproszenie, haslo FROM grupa_quizowa UNION ALL
SELECT (SELECT max(id_grupy) FROM grupa_quizowa) + row_number() OVER (ORDER BY nr), id_wlasciciela, nazwa,
  coalesce(na_zaproszenie, false), haslo FROM grupy_ocenione WHERE powod IS NULL""",
    "create_groups_rejects": "SELECT nr, nazwa, powod FROM grupy_ocenione WHERE powod IS NOT NULL",
    "delete_quizzes_quiz": f"""
SELECT {QUIZ} FROM quiz WHERE id_quizu NOT IN (SELECT id_quizu FROM quizy_do_usuniecia)""",
    "delete_quizzes_pytanie": f"""
SELECT {QUESTION} FROM pytanie WHERE id_pyt NOT IN (SELECT id_pyt FROM pytania_usuwane)""",
    "delete_quizzes_odpowiedz_wzorcowa": """
SELECT * FROM odpowiedz_wzorcowa WHERE id_pyt NOT IN (SELECT id_pyt FROM pytania_usuwane)""",
    "delete_quizzes_odpowiedz_uzytkownika": """
SELECT * FROM odpowiedz_uzytkownika WHERE id_pyt NOT IN (SELECT id_pyt FROM pytania_usuwane)""",
    "delete_quizzes_dyskusja": """
SELECT * FROM dyskusja WHERE id_quizu NOT IN (SELECT id_quizu FROM quizy_do_usuniecia)""",
    "delete_users_uzytkownik": """
SELECT * FROM uzytkownik WHERE id_uz = 0 OR id_uz NOT IN (SELECT id_uz FROM uzytkownicy_do_usuniecia)""",
    "delete_users_quiz": """
SELECT id_quizu, CASE WHEN z.id_uz IS NULL THEN id_wlasciciela ELSE 0 END AS id_wlasciciela, nazwa,
  CASE WHEN z.id_uz IS NULL THEN id_grupy ELSE 0 END AS id_grupy, limit_podejsc, limit_czasowy, data_utworzenia, ukryty
FROM quiz LEFT JOIN (SELECT id_uz FROM uzytkownicy_do_usuniecia WHERE id_uz <> 0) z ON z.id_uz = id_wlasciciela""",
    "delete_users_dostep_grupa": """
SELECT * FROM dostep_grupa WHERE id_uz NOT IN (SELECT id_uz FROM uzytkownicy_do_usuniecia WHERE id_uz <> 0)""",
    "delete_users_grupa_quizowa": """
SELECT id_grupy, CASE WHEN id_wlasciciela IN (SELECT id_uz FROM uzytkownicy_do_usuniecia WHERE id_uz <> 0) THEN 0 ELSE id_wlasciciela END AS id_wlasciciela,
  nazwa, na_zaproszenie, haslo FROM grupa_quizowa""",
    "delete_users_pytanie": """
SELECT id_pyt, tresc, id_typu, CASE WHEN id_autora IN (SELECT id_uz FROM uzytkownicy_do_usuniecia WHERE id_uz <> 0) THEN 0 ELSE id_autora END AS id_autora,
  pkt, id_quizu, id_kategorii, ukryty FROM pytanie""",
    "delete_users_ranking": """
SELECT * FROM ranking WHERE id_uz NOT IN (SELECT id_uz FROM uzytkownicy_do_usuniecia WHERE id_uz <> 0)""",
    "delete_users_odpowiedz_uzytkownika": """
SELECT * FROM odpowiedz_uzytkownika WHERE id_uz NOT IN (SELECT id_uz FROM uzytkownicy_do_usuniecia WHERE id_uz <> 0)""",
    "delete_users_dyskusja": """
SELECT * FROM dyskusja WHERE id_uz NOT IN (SELECT id_uz FROM uzytkownicy_do_usuniecia WHERE id_uz <> 0)""",
    "create_users": """
SELECT id_uz, login, nazwa_uz, email, ranga FROM uzytkownik UNION ALL
SELECT (SELECT max(id_uz) FROM uzytkownik) + row_number() OVER (ORDER BY nr), login, nazwa_uz, email, 'user'
FROM nowi_ocenieni WHERE powod IS NULL""",
    "create_users_rejects": "SELECT nr, login, powod FROM nowi_ocenieni WHERE powod IS NOT NULL",
    "delete_groups_grupa_quizowa": "SELECT id_grupy, id_wlasciciela, nazwa, na_zaproszenie, haslo FROM grupa_quizowa WHERE NOT na_zaproszenie",
    "delete_groups_quiz": """
SELECT id_quizu, id_wlasciciela, nazwa, CASE WHEN id_grupy IN (SELECT id_grupy FROM grupa_quizowa WHERE na_zaproszenie) THEN 0 ELSE id_grupy END AS id_grupy,
  limit_podejsc, limit_czasowy, data_utworzenia, ukryty FROM quiz""",
    "delete_groups_dostep_grupa": """
SELECT * FROM dostep_grupa WHERE id_grupy NOT IN (SELECT id_grupy FROM grupa_quizowa WHERE na_zaproszenie)""",
    "delete_groups_ranking": """
SELECT * FROM ranking WHERE id_grupy NOT IN (SELECT id_grupy FROM grupa_quizowa WHERE na_zaproszenie)""",
    "delete_categories_kategoria": f"SELECT * FROM kategoria WHERE id_kategorii NOT IN ({GONE_CATEGORIES})",
    "delete_categories_podkategoria": f"""
SELECT * FROM podkategoria WHERE id_podkategorii NOT IN ({GONE_CATEGORIES}) AND id_nadkategorii NOT IN ({GONE_CATEGORIES})""",
    "delete_categories_pytanie": f"SELECT {QUESTION} FROM pytanie WHERE id_kategorii NOT IN ({GONE_CATEGORIES})",
    "delete_categories_odpowiedz_wzorcowa": f"""
SELECT * FROM odpowiedz_wzorcowa WHERE id_pyt IN (SELECT id_pyt FROM pytanie WHERE id_kategorii NOT IN ({GONE_CATEGORIES}))""",
    "delete_categories_odpowiedz_uzytkownika": f"""
SELECT * FROM odpowiedz_uzytkownika WHERE id_pyt IN (SELECT id_pyt FROM pytanie WHERE id_kategorii NOT IN ({GONE_CATEGORIES}))""",
    "update_profiles": """
SELECT u.id_uz, coalesce(n.login, u.login) AS login, coalesce(n.nazwa_uz, u.nazwa_uz) AS nazwa_uz,
  coalesce(n.email, u.email) AS email, u.ranga
FROM uzytkownik u LEFT JOIN (
  SELECT id_uz, arg_max(login, nr) FILTER (WHERE login IS NOT NULL) AS login,
    arg_max(nazwa_uz, nr) FILTER (WHERE nazwa_uz IS NOT NULL) AS nazwa_uz,
    arg_max(email, nr) FILTER (WHERE email IS NOT NULL) AS email
  FROM profile_ocenione WHERE powod IS NULL GROUP BY 1) n ON n.id_uz = u.id_uz""",
    "update_profiles_rejects": """
SELECT nr, id_uz, powod FROM profile_ocenione WHERE powod IS NOT NULL
UNION ALL SELECT nr, id_uz, 'no_user' FROM zmiany_profili WHERE id_uz NOT IN (SELECT id_uz FROM uzytkownik)""",
    # generation
    "question_blocks": """
SELECT zrodlo, blok, pytanie, coalesce(array_to_string(odpowiedzi, '|'), '') AS odpowiedzi FROM bloki""",
    "generate_quiz_set_pytanie": """
SELECT i + 1001 AS id_pyt, pytanie AS tresc, CAST(3 AS BIGINT) AS id_typu, CAST(1 AS BIGINT) AS id_autora,
  CAST(1 AS DOUBLE) AS pkt, 101 + i % 40 AS id_quizu, CAST(1 AS BIGINT) AS id_kategorii, false AS ukryty FROM bloki_nr""",
    "generate_quiz_set_quiz": """
SELECT 101 + i AS id_quizu, CAST(1 AS BIGINT) AS id_wlasciciela, 'dokumenty ' || (i + 1) AS nazwa, CAST(1 AS BIGINT) AS id_grupy,
  CAST(NULL AS INTEGER) AS limit_podejsc, CAST(NULL AS VARCHAR) AS limit_czasowy, TIMESTAMP '2020-01-01' AS data_utworzenia, false AS ukryty
FROM range(40) r(i)""",
    "generate_chain_quiz": """
SELECT q0 + i AS id_quizu, CAST(1 AS BIGINT) AS id_wlasciciela, n || ' ' || (i + 1) AS nazwa, CAST(1 AS BIGINT) AS id_grupy,
  CAST(NULL AS INTEGER) AS limit_podejsc, CAST(NULL AS VARCHAR) AS limit_czasowy, TIMESTAMP '2020-01-01' AS data_utworzenia, false AS ukryty
FROM (VALUES ('dokumenty', 101, 40), ('testy', 141, 7), ('rozmowy', 148, 9)) v(n, q0, ile), range(40) r(i) WHERE i < ile""",
    "generate_chain_pytanie": """
SELECT i + 1001 AS id_pyt, coalesce(pytanie, '') AS tresc, id_typu, CAST(1 AS BIGINT) AS id_autora, CAST(1 AS DOUBLE) AS pkt,
  q0 + w % quizy AS id_quizu, CAST(1 AS BIGINT) AS id_kategorii, false AS ukryty FROM zestawy_nr""",
    "generate_chain_odpowiedz": """
SELECT CAST(5001 + o0 + s AS BIGINT) AS id_odp_w, i + 1001 AS id_pyt, coalesce(odpowiedzi[s + 1], '') AS tresc_odp,
  CASE WHEN s = 0 THEN 100 ELSE 0 END AS poziom_poprawnosci, CAST(NULL AS VARCHAR) AS komentarz
FROM zestawy_nr, (VALUES (0), (1), (2), (3)) v(s) WHERE s < ile""",
    "generate_chain_summary": """
SELECT CASE z WHEN 1 THEN 'dokumenty' WHEN 2 THEN 'testy' ELSE 'rozmowy' END AS zestaw, CAST(any_value(quizy) AS BIGINT) AS quizy,
  count(*) AS pytania FROM zestawy GROUP BY z""",
    "generate_quiz_set_odpowiedz": """
SELECT 5001 + i * 4 + s AS id_odp_w, i + 1001 AS id_pyt, coalesce(odpowiedzi[s + 1], '') AS tresc_odp,
  CASE WHEN s = 0 THEN 100 ELSE 0 END AS poziom_poprawnosci, CAST(NULL AS VARCHAR) AS komentarz
FROM bloki_nr, (VALUES (0), (1), (2), (3)) v(s)""",
    "generation_summary": "SELECT 'dokumenty' AS zestaw, CAST(40 AS BIGINT) AS quizy, count(*) AS pytania FROM bloki",
    # data quality
    "publish_tables": f"""
SELECT tabela, regula, count(*) AS wiersze FROM (
  SELECT 'uzytkownik' AS tabela, 'email_format' AS regula FROM uzytkownik WHERE NOT regexp_matches(email, '{EMAIL}')
  UNION ALL SELECT 'uzytkownik', 'email_za_dlugi' FROM uzytkownik WHERE length(email) > 60
  UNION ALL SELECT 'uzytkownik', 'nazwa_uz_za_dluga' FROM uzytkownik WHERE length(nazwa_uz) > 30
  UNION ALL SELECT 'uzytkownik', 'login_za_dlugi' FROM uzytkownik WHERE length(login) > 15
  UNION ALL SELECT 'odpowiedz_wzorcowa', 'poziom_wielokrotny' FROM odpowiedz_wzorcowa JOIN pytanie USING (id_pyt)
  WHERE id_typu BETWEEN 6 AND 10 AND poziom_poprawnosci NOT IN (0, 100)) GROUP BY ALL""",
    "published_questions": f"SELECT {QUESTION} FROM pytanie WHERE NOT ukryty",
    "stored_quizzes": f"SELECT {QUIZ} FROM quiz",
    "stored_answers": "SELECT * FROM odpowiedz_uzytkownika",
    "stored_submissions": """
SELECT a.id_uz, a.id_quizu % 25 + CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END AS id_grupy, a.id_quizu, a.data_wyslania,
  a.id_quizu * 10 + e.k AS id_pyt, e.wybrane, e.open_text
FROM attempts a LEFT JOIN (
  SELECT l_orderkey AS o_orderkey, l_linenumber AS k, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS wybrane,
    min(l_returnflag) AS open_text FROM lineitem GROUP BY ALL) e USING (o_orderkey)""",
    "file_lines": r"""
SELECT plik, row_number() OVER (PARTITION BY plik ORDER BY doc_id, nr) - 1 AS nr_linii, md5(regexp_replace(linia, '\r\z', '')) AS linia
FROM (SELECT doc_id // 100 AS plik, doc_id, unnest(l) AS linia, generate_subscripts(l, 1) AS nr
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))""",
    "kept_ranking": """
SELECT id_uz, id_grupy, round(sum(m), 6) AS pkt, count(*) AS quizy FROM (
  SELECT id_uz, id_quizu, max(zdobyte_pkt) AS m FROM podejscia WHERE NOT (id_uz % 3 <> 0 AND id_quizu % 5 = 0) GROUP BY ALL)
JOIN quiz q USING (id_quizu) WHERE q.id_grupy <> 0 GROUP BY ALL""",
    "kept_member_counts": """
SELECT g.id_grupy, count(u.id_uz) AS uzytkownicy FROM grupa_quizowa g
LEFT JOIN dostep_grupa d ON d.id_grupy = g.id_grupy AND d.id_uz % 4 <> 1
LEFT JOIN uzytkownik u ON u.id_uz = d.id_uz AND u.id_uz <> 0 AND u.ranga NOT IN ('moderator', 'administrator') GROUP BY 1""",
    "kept_quiz_counts": """
SELECT g.id_grupy, count(q.id_quizu) AS quizy FROM grupa_quizowa g LEFT JOIN (
  SELECT q.id_quizu, q.id_grupy, coalesce(c.ukryty, q.ukryty) AS ukryty
  FROM quiz q LEFT JOIN (SELECT id_quizu, arg_max(ukryty, nr) AS ukryty FROM zmiany_widocznosci GROUP BY 1) c USING (id_quizu)) q
ON q.id_grupy = g.id_grupy AND NOT q.ukryty GROUP BY 1""",
    "check_not_null_tables": """
SELECT 'uzytkownik' AS tabela, 'nie_null' AS regula, 'nazwa_uz' AS klucz, count(*) AS wiersze FROM uzytkownik WHERE ranga = 'teacher'
UNION ALL SELECT 'quiz', 'nie_null', 'data_utworzenia', count(*) FROM quiz WHERE ukryty""",
    "check_users": f"""
SELECT 'uzytkownik' AS tabela, regula, CAST(id_uz AS VARCHAR) AS klucz FROM (
  SELECT id_uz, 'email_format' AS regula FROM uzytkownik WHERE NOT regexp_matches(email, '{EMAIL}')
  UNION ALL SELECT id_uz, 'email_za_dlugi' FROM uzytkownik WHERE length(email) > 60
  UNION ALL SELECT id_uz, 'nazwa_uz_za_dluga' FROM uzytkownik WHERE length(nazwa_uz) > 30
  UNION ALL SELECT id_uz, 'login_za_dlugi' FROM uzytkownik WHERE length(login) > 15)""",
    "check_groups": """
SELECT 'grupa_quizowa' AS tabela, regula, CAST(nr AS VARCHAR) AS klucz FROM (
  SELECT nr, 'nazwa_pusta' AS regula FROM nowe_grupy WHERE trim(nazwa) = ''
  UNION ALL SELECT nr, 'nazwa_za_dluga' FROM nowe_grupy WHERE length(nazwa) > 60)""",
    "check_questions": """
SELECT 'pytanie' AS tabela, regula, CAST(nr AS VARCHAR) AS klucz FROM (
  SELECT nr, 'tresc_pusta' AS regula FROM zmiany_pytan WHERE trim(coalesce(tresc, '')) = ''
  UNION ALL SELECT nr, 'pkt_puste' FROM zmiany_pytan WHERE pkt IS NULL
  UNION ALL SELECT nr, 'pkt_ujemne' FROM zmiany_pytan WHERE pkt < 0)""",
    "check_templates": """
SELECT 'odpowiedz_wzorcowa' AS tabela, regula, CAST(nr AS VARCHAR) AS klucz FROM (
  SELECT nr, 'tresc_odp_pusta' AS regula FROM zmiany_odpowiedzi WHERE trim(tresc_odp) = ''
  UNION ALL SELECT nr, 'poziom_poza_zakresem' FROM zmiany_odpowiedzi WHERE poziom_poprawnosci > 100
  UNION ALL SELECT c.nr, 'poziom_wielokrotny' FROM zmiany_odpowiedzi c JOIN pytanie p USING (id_pyt)
  JOIN typ t USING (id_typu) WHERE t.wielokrotnego_wyboru AND c.poziom_poprawnosci NOT IN (0, 100))""",
    "check_unique": """
SELECT tabela, regula, klucz FROM (
  SELECT 'uzytkownik' AS tabela, 'unikalne_email' AS regula, email AS klucz FROM uzytkownik
  UNION ALL SELECT 'uzytkownik', 'unikalne_login', login FROM uzytkownik
  UNION ALL SELECT 'uzytkownik', 'unikalne_nazwa_uz', nazwa_uz FROM uzytkownik
  UNION ALL SELECT 'grupa_quizowa', 'unikalne_nazwa', nazwa FROM nowe_grupy
  UNION ALL SELECT 'kategoria', 'unikalne_nazwa', nazwa FROM kategoria
  UNION ALL SELECT 'typ', 'unikalne_nazwa', nazwa FROM typ
  UNION ALL SELECT 'podkategoria', 'unikalne_id_podkategorii', CAST(id_podkategorii AS VARCHAR) FROM podkategoria
  UNION ALL SELECT 'dostep_grupa', 'unikalne_id_grupy_id_uz', id_grupy || ',' || id_uz FROM dostep_grupa
  UNION ALL SELECT 'ranking', 'unikalne_id_uz_id_grupy', id_uz || ',' || id_grupy FROM ranking)
GROUP BY ALL HAVING count(*) > 1""",
    "check_not_null": """
SELECT tabela, 'nie_null' AS regula, klucz, wiersze FROM (
  SELECT 'pytanie' AS tabela, 'tresc' AS klucz, count(*) FILTER (WHERE tresc IS NULL) AS wiersze FROM zmiany_pytan
  UNION ALL SELECT 'pytanie', 'id_typu', count(*) FILTER (WHERE id_typu IS NULL) FROM zmiany_pytan
  UNION ALL SELECT 'pytanie', 'pkt', count(*) FILTER (WHERE pkt IS NULL) FROM zmiany_pytan
  UNION ALL SELECT 'pytanie', 'id_kategorii', count(*) FILTER (WHERE id_kategorii IS NULL) FROM zmiany_pytan
  UNION ALL SELECT 'quiz', 'id_grupy', count(*) FILTER (WHERE id_grupy IS NULL) FROM nowe_quizy
  UNION ALL SELECT 'grupa_quizowa', 'na_zaproszenie', count(*) FILTER (WHERE na_zaproszenie IS NULL) FROM nowe_grupy)
WHERE wiersze > 0""",
    # categories and discussions
    "category_closure": """
SELECT * FROM (
  SELECT id_nadkategorii AS id_przodka, id_podkategorii AS id_potomka, 1 AS glebokosc FROM podkategoria
  UNION ALL SELECT a.id_nadkategorii, b.id_podkategorii, 2 FROM podkategoria a
  JOIN podkategoria b ON b.id_nadkategorii = a.id_podkategorii)""",
    "category_cycles": """
WITH RECURSIVE w_dol AS (
  SELECT min(p_partkey) * 7 % 50 + 1 AS nad, CAST(p_size AS BIGINT) AS pod FROM part GROUP BY p_size
), w_droga AS (
  SELECT nad, pod, 1 AS n FROM w_dol UNION ALL
  SELECT d.nad, e.pod, d.n + 1 FROM w_droga d JOIN w_dol e ON e.nad = d.pod WHERE d.n < 100
), w_par AS (SELECT nad, pod, min(n) AS n FROM w_droga GROUP BY ALL)
SELECT min(b.pod) AS cykl, a.nad AS id_kategorii, CAST(a.n AS INTEGER) AS dlugosc
FROM w_par a JOIN w_par b ON b.nad = a.nad JOIN w_par c ON c.nad = b.pod AND c.pod = b.nad
WHERE a.nad = a.pod GROUP BY a.nad, a.n""",
    "quiz_categories": """
SELECT DISTINCT p.id_quizu, k.id_kategorii, k.nazwa AS kategoria FROM pytanie p JOIN kategoria k USING (id_kategorii)""",
    "discussion_feed": f"""
SELECT p.id_quizu, q.id_grupy, p.id_uz, u.nazwa_uz, p.tresc, p.data_wyslania
FROM dyskusja p JOIN quiz q USING (id_quizu) JOIN uzytkownik u ON u.id_uz = p.id_uz
WHERE {may("p.id_uz", "q.id_grupy", 2)}""",
    "live_ranking": """
SELECT b.id_uz, q.id_grupy, round(sum(b.m), 6) AS pkt FROM (
  SELECT id_uz, id_quizu, max(s) AS m FROM (
    SELECT id_uz, id_quizu, data_wyslania, round(sum(g), 6) AS s FROM (
      SELECT o.id_uz, p.id_quizu, o.data_wyslania, o.id_pyt, CASE
        WHEN p.id_typu = 7 THEN CASE WHEN bool_and(o.zaznaczona = (k.poziom = 100)) THEN any_value(p.pkt) ELSE 0 END
        WHEN p.id_typu = 11 THEN any_value(p.pkt) * max(coalesce(k.poziom, 0)) / 100
        WHEN count(*) FILTER (WHERE o.zaznaczona) = 1
          THEN any_value(p.pkt) * max(k.poziom) FILTER (WHERE o.zaznaczona) / 100 ELSE 0 END AS g
      FROM wyslane o JOIN pytanie p USING (id_pyt)
      LEFT JOIN (SELECT id_pyt, tresc_odp, max(poziom_poprawnosci) AS poziom FROM odpowiedz_wzorcowa GROUP BY ALL) k
        ON k.id_pyt = o.id_pyt AND k.tresc_odp = o.tresc_odp
      GROUP BY o.id_uz, p.id_quizu, o.data_wyslania, o.id_pyt, p.id_typu)
    GROUP BY ALL) GROUP BY ALL) b JOIN quiz q USING (id_quizu) WHERE q.id_grupy <> 0 GROUP BY ALL""",
}


def _reference(text: str) -> tuple[str, str, str, str]:
    child, parent = text.split()
    table, key = child.split(".")
    return (table, key, *(parent.split(".") if "." in parent else (parent, key)))


def _orphans() -> str:
    kept = {
        "uzytkownik": "id_uz NOT IN (SELECT id_uz FROM uzytkownicy_do_usuniecia)",
        "pytanie": "id_pyt NOT IN (SELECT id_pyt FROM pytania_do_usuniecia)",
    }
    parts = [
        f"""SELECT '{child}' AS tabela, '{key}' AS klucz, {key} AS wartosc, count(*) AS wiersze FROM {child}
WHERE {kept.get(child, "true")} AND {key} NOT IN (SELECT {pkey} FROM {parent} WHERE {kept.get(parent, "true")}) GROUP BY {key}"""
        for child, key, parent, pkey in map(_reference, REFERENCES.split(","))
    ]
    return "\nUNION ALL ".join(parts)


SQL["orphans"] = _orphans()
SQL["submit_ranking"] = SQL["live_ranking"]
for _plain, _other in {
    "is_enrolled": "enrolled_by_bitmaps",
    "not_enrolled": "not_enrolled_by_bitmaps",
    "has_privileges_edit": "privileges_by_bitmaps",
    "lookup_by_key": "lookup_indexed",
    "template_lookup": "template_lookup_indexed",
}.items():
    SQL[_other] = SQL[_plain]
SQL["live_members"] = SQL["gate_submissions_members"]


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(sql, {**REQUESTS, **STEPS}) for name, sql in SQL.items()}
