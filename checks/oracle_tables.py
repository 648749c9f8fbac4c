"""The domain tables of FIXTURES.md as DuckDB common table expressions."""

import re

TYPES = """
SELECT * FROM (VALUES
  (1,'jednokrotny 2',2,false),(2,'jednokrotny 3',3,false),(3,'jednokrotny 4',4,false),
  (4,'jednokrotny 5',5,false),(5,'jednokrotny 6',6,false),(6,'wielokrotny 2',2,true),
  (7,'wielokrotny 3',3,true),(8,'wielokrotny 4',4,true),(9,'wielokrotny 5',5,true),
  (10,'wielokrotny 6',6,true),(11,'otwarte',1,false)) t(id_typu,nazwa,liczba_odp,wielokrotnego_wyboru)
"""

CTES = {
    "typ": "SELECT CAST(id_typu AS BIGINT) AS id_typu, nazwa, liczba_odp, wielokrotnego_wyboru FROM (" + TYPES + ")",
    "uzytkownik": """
SELECT c_custkey AS id_uz, 'u' || c_custkey AS login, c_name AS nazwa_uz,
  CASE WHEN c_custkey % 89 = 7 THEN 'shared@ex.pl' WHEN c_custkey % 97 = 5 THEN 'broken'
       ELSE 'u' || c_custkey || '@ex.pl' END AS email,
  CASE WHEN c_custkey = 0 THEN 'user' WHEN c_custkey % 50 = 1 THEN 'moderator'
       WHEN c_custkey % 50 = 2 THEN 'administrator' WHEN c_custkey % 10 = 3 THEN 'teacher'
       ELSE 'user' END AS ranga
FROM customer""",
    "grupa_quizowa": """
SELECT CAST(n_nationkey AS BIGINT) AS id_grupy,
  CAST(CASE WHEN n_nationkey = 0 THEN 0 ELSE n_nationkey * 3 + 1 END AS BIGINT) AS id_wlasciciela,
  n_name AS nazwa, n_nationkey % 5 = 3 AS na_zaproszenie,
  CASE WHEN n_nationkey % 6 = 4 THEN 'x' WHEN n_nationkey = 13 THEN ' ' END AS haslo
FROM nation""",
    "kategoria": """
SELECT CAST(1 AS BIGINT) AS id_kategorii, 'Pytania' AS nazwa
UNION ALL SELECT 2 + r_regionkey, r_name FROM region
UNION ALL SELECT 10 + n_nationkey, n_name FROM nation""",
    "podkategoria": """
SELECT CAST(1 AS BIGINT) AS id_nadkategorii, CAST(2 + r_regionkey AS BIGINT) AS id_podkategorii FROM region
UNION ALL SELECT 2 + n_regionkey, 10 + n_nationkey FROM nation""",
    "quiz": """
SELECT p_partkey AS id_quizu, p_partkey % 150 AS id_wlasciciela, p_name AS nazwa, p_partkey % 25 AS id_grupy,
  nullif(p_size % 5, 0) AS limit_podejsc,
  CASE WHEN p_size % 3 = 0 THEN p_size || ' minutes' END AS limit_czasowy,
  TIMESTAMP '1994-01-01' + to_hours(p_partkey) AS data_utworzenia, p_size % 7 = 0 AS ukryty
FROM part""",
    "pytanie": """
SELECT id_quizu * 10 + k AS id_pyt, nazwa || ' ' || k AS tresc,
  CAST(CASE WHEN k = 2 THEN 1 WHEN k <= 3 THEN 2 WHEN k <= 5 THEN 7 ELSE 11 END AS BIGINT) AS id_typu,
  id_quizu % 150 AS id_autora, 1 + (k % 3) * 0.5::DOUBLE AS pkt, id_quizu,
  10 + (id_quizu * 10 + k) % 25 AS id_kategorii, (id_quizu * 10 + k) % 11 = 0 AS ukryty
FROM quiz, (VALUES (1),(2),(3),(4),(5),(6),(7)) ks(k)""",
    "odpowiedz_wzorcowa": """
SELECT id_pyt * 10 + i AS id_odp_w, id_pyt, o AS tresc_odp,
  CASE WHEN id_pyt % 10 = 5 AND id_quizu % 9 = 4 THEN 0 WHEN i = id_pyt % 3 THEN 100
       WHEN id_pyt % 10 >= 6 AND i = (id_pyt + 1) % 3 THEN 40 ELSE 0 END AS poziom_poprawnosci,
  CASE WHEN i = 1 THEN 'c' || (id_pyt * 10 + i) END AS komentarz,
  CAST(NULL AS TIMESTAMP) AS ost_modyfikacja
FROM pytanie, (VALUES (0,'A'),(1,'N'),(2,'R')) os(i, o)
WHERE NOT (id_pyt % 10 = 3 AND id_quizu % 13 = 5 AND i = 2)
UNION ALL SELECT id_pyt * 10 + 9, id_pyt, 'A', 0, NULL, NULL FROM pytanie
WHERE id_pyt % 10 = 6 AND id_quizu % 40 = 0""",
    "attempts": """
SELECT o_custkey AS id_uz, (3 * o_custkey + o_orderkey % 4) % (SELECT count(*) FROM part) AS id_quizu,
  o_orderdate + to_milliseconds(o_orderkey) AS data_wyslania, o_orderkey
FROM orders""",
    "dostep_grupa": """
SELECT id_grupy, id_uz,
  CASE (id_uz + id_grupy) % 6 WHEN 0 THEN '1111100000000000' WHEN 1 THEN '0000000000000000'
       WHEN 2 THEN '1111100000000001' ELSE '1100000000000000' END AS prawa_dost
FROM (SELECT q.id_grupy, a.id_uz FROM attempts a JOIN quiz q USING (id_quizu)
      WHERE a.o_orderkey % 5 <> 0 AND q.id_grupy <> 0 AND a.id_uz <> 0
      UNION SELECT CAST(1 AS BIGINT), id_uz FROM uzytkownik WHERE id_uz <> 0)""",
    "odpowiedz_uzytkownika": """
SELECT a.o_orderkey * 100 + w.id_odp_w % 100 AS id_odp_u, a.id_uz, w.tresc_odp, p.id_pyt, a.data_wyslania,
  EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = a.o_orderkey
          AND l.l_linenumber = p.id_pyt % 10 AND l.l_returnflag = w.tresc_odp) AS zaznaczona
FROM attempts a JOIN pytanie p USING (id_quizu) JOIN odpowiedz_wzorcowa w ON w.id_pyt = p.id_pyt
WHERE NOT p.ukryty AND p.id_typu <> 11
UNION ALL
SELECT a.o_orderkey * 100 + (p.id_pyt % 10) * 10, a.id_uz,
  coalesce((SELECT min(l_returnflag) FROM lineitem l WHERE l.l_orderkey = a.o_orderkey
            AND l.l_linenumber = p.id_pyt % 10), 'nil'), p.id_pyt, a.data_wyslania, true
FROM attempts a JOIN pytanie p USING (id_quizu) WHERE NOT p.ukryty AND p.id_typu = 11""",
    "dyskusja": """
SELECT event_id % (SELECT count(*) FROM part) AS id_quizu, user_id AS id_uz, event_type AS tresc, ts AS data_wyslania
FROM events""",
    # scoring, used by several checks
    "punkty": """
SELECT o.id_uz, o.id_pyt, p.id_quizu, o.data_wyslania,
  CASE WHEN t.wielokrotnego_wyboru THEN 'multi' WHEN t.liczba_odp = 1 THEN 'open' ELSE 'single' END AS rodzaj,
  round(CASE
    WHEN t.wielokrotnego_wyboru THEN
      CASE WHEN count(*) FILTER (WHERE o.zaznaczona <> (coalesce(k.poziom, 0) = 100)) = 0 THEN any_value(p.pkt) ELSE 0 END
    WHEN t.liczba_odp = 1 THEN any_value(p.pkt) * max(coalesce(k.poziom, 0)) / 100
    WHEN count(*) FILTER (WHERE o.zaznaczona) = 1
      THEN any_value(p.pkt) * max(coalesce(k.poziom, 0)) FILTER (WHERE o.zaznaczona) / 100
    ELSE 0 END, 6) AS zdobyte_pkt,
  any_value(p.pkt) AS max_pkt
FROM odpowiedz_uzytkownika o JOIN pytanie p ON p.id_pyt = o.id_pyt JOIN typ t ON t.id_typu = p.id_typu
LEFT JOIN (SELECT id_pyt, tresc_odp, max(poziom_poprawnosci) AS poziom FROM odpowiedz_wzorcowa GROUP BY ALL) k
  ON k.id_pyt = o.id_pyt AND k.tresc_odp = o.tresc_odp
GROUP BY o.id_uz, o.id_pyt, p.id_quizu, o.data_wyslania, t.wielokrotnego_wyboru, t.liczba_odp""",
    "podejscia": """
SELECT id_uz, data_wyslania, id_quizu, round(sum(zdobyte_pkt), 6) AS zdobyte_pkt, round(sum(max_pkt), 6) AS max_pkt
FROM punkty GROUP BY ALL""",
    "ranking": """
SELECT b.id_uz, q.id_grupy, round(sum(b.m), 6) AS pkt
FROM (SELECT id_uz, id_quizu, max(zdobyte_pkt) AS m FROM podejscia GROUP BY ALL) b JOIN quiz q USING (id_quizu)
WHERE q.id_grupy <> 0 GROUP BY ALL""",
    # does a question have enough templates and a right one
    "waznosc": """
SELECT p.id_pyt, count(w.id_odp_w) AS odpowiedzi,
  count(w.id_odp_w) FILTER (WHERE w.poziom_poprawnosci = 100) AS w_pelni_poprawne,
  count(w.id_odp_w) >= t.liczba_odp
    AND (t.wielokrotnego_wyboru OR count(w.id_odp_w) FILTER (WHERE w.poziom_poprawnosci = 100) > 0) AS poprawne
FROM pytanie p JOIN typ t USING (id_typu) LEFT JOIN odpowiedz_wzorcowa w ON w.id_pyt = p.id_pyt
GROUP BY p.id_pyt, t.liczba_odp, t.wielokrotnego_wyboru""",
}


def may(user: str, group: str, *bits: int) -> str:
    """SQL condition: superuser, owner, or all the given bits (1 = leftmost) set."""
    wanted = " AND ".join(f"substr(d.prawa_dost, {b}, 1) = '1'" for b in bits) or "true"
    return f"""(EXISTS (SELECT 1 FROM uzytkownik u WHERE u.id_uz = {user} AND u.ranga IN ('moderator', 'administrator'))
 OR EXISTS (SELECT 1 FROM grupa_quizowa g WHERE g.id_grupy = {group} AND g.id_wlasciciela = {user})
 OR EXISTS (SELECT 1 FROM dostep_grupa d WHERE d.id_uz = {user} AND d.id_grupy = {group} AND {wanted}))"""


def with_tables(sql: str, extra: dict[str, str] | None = None) -> str:
    """Puts the table expressions that ``sql`` needs in front of it, in order of need."""
    known = {**CTES, **(extra or {})}
    ordered: dict[str, str] = {}

    def need(text: str, inside: tuple[str, ...]) -> None:
        words = set(re.findall(r"[a-z_]\w*", re.sub(r"'[^']*'", "", text)))
        for name in known:
            if name in words and name not in ordered and name not in inside:
                need(known[name], (*inside, name))
                ordered[name] = known[name].strip()

    need(sql, ())
    heads = ",\n".join(f"{name} AS ({body})" for name, body in ordered.items())
    return f"WITH {heads}\n{sql.strip()}" if heads else sql.strip()
