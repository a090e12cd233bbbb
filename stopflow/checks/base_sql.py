"""SQL for the projected tables and the main derived ones. Written independently of the
Spark operators: other formulations wherever there is one."""

from __future__ import annotations

from ..functions.geo import WGS84_A, WGS84_F

ARRIVALS = """
numbered AS (
  SELECT l_orderkey AS j, l_partkey AS part, l_suppkey % 5 AS k, (l_suppkey // 5) % 2 AS p,
    CAST(l_quantity AS BIGINT) AS qty, l_orderkey // 60 AS g,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
      l_quantity, l_extendedprice, l_shipdate) AS nr,
    count(*) OVER (PARTITION BY l_orderkey) AS cnt
  FROM lineitem
), clocked AS (
  SELECT *, DATE '2024-01-01' + CAST(j % 60 AS INT) AS od,
    CASE j % 20 WHEN 0 THEN 'SOF' WHEN 10 THEN 'BBB' ELSE 'AAA' END AS src,
    (19723 + j % 60) * 86400 + (7 + g % 2) * 3600 + 300 * (nr - 1)
      - CASE WHEN nr > 1 AND part % 16 = 3 THEN 300 ELSE 0 END AS aim,
    6 * qty - 60 + CASE WHEN part % 500 = 2 THEN 8000 ELSE 0 END AS late
  FROM numbered
), arrivals AS (
  SELECT make_timestamp((aim + late + 30) * 1000000) AS recordedAtTime,
    src || ':Line:' || CASE WHEN g % 7 = 6 THEN 'Express' ELSE '2_' || (g % 7) END AS lineRef,
    CASE WHEN (g % 2 = 0) <> (od >= DATE '2024-02-01') THEN 'Inbound' ELSE 'Outbound' END
      AS directionRef,
    od AS operatingDate, src || ':ServiceJourney:' || j AS serviceJourneyId,
    CASE WHEN part % 200 = 1 THEN 'NSR:Quay:missing'
      WHEN part % 10 = 0 THEN 'NSR:StopPlace:' || k
      ELSE 'NSR:Quay:' || k || '_' || p END AS stopPointRef,
    'Stop ' || k AS stopPointName, nr AS sequenceNr,
    CASE WHEN j % 3 = 0 THEN 'Stop 0' END AS originName,
    CASE WHEN j % 3 = 0 THEN 'Stop 4' END AS destinationName,
    CASE WHEN j % 4 = 0 THEN 'bus' END AS vehicleMode,
    j % 83 = 0 AS extraCall, ((j % 61 = 5 AND nr = 2) OR (j % 89 = 7 AND nr IN (2, 3, 5))) AS stopCancellation,
    (j % 97 = 0 AND nr >= 4) AS journeyCancellation, (j % 50 = 7 AND nr >= 3) AS estimated,
    CASE WHEN nr > 1 THEN make_timestamp(aim * 1000000) END AS aimedArrivalTime,
    CASE WHEN nr > 1 THEN make_timestamp((aim + late) * 1000000) END AS arrivalTime,
    CASE WHEN nr < cnt THEN make_timestamp((aim + 30) * 1000000) END AS aimedDepartureTime,
    CASE WHEN nr < cnt THEN make_timestamp((aim + late + 30) * 1000000) END AS departureTime,
    src AS dataSource, 'Operator ' || src AS dataSourceName, src AS operatorRef, false AS extraJourney,
    od || ':' || src || ':ServiceJourney:' || j AS datedServiceJourneyId
  FROM clocked
)"""

QUAYS = """
quays AS (
  SELECT DISTINCT 'NSR:Quay:' || (s_suppkey % 5) || '_' || ((s_suppkey // 5) % 2) AS id,
    'NSR:StopPlace:' || (s_suppkey % 5) AS stopPlaceRef, 'Quay ' || (s_suppkey % 5) AS name,
    63.4001 + 0.010 * CAST(s_suppkey % 5 AS DOUBLE) AS lat,
    10.3501 + 0.013 * CAST(s_suppkey % 5 AS DOUBLE) AS lon
  FROM supplier
)"""

STOPDATA = """
stopdata AS (
  SELECT q.id AS quay_id, q.stopPlaceRef AS stop_id, 'Stop ' || k AS name,
    CASE WHEN k = 3 THEN q.lat ELSE 63.40 + 0.010 * k END AS lat,
    CASE WHEN k = 3 THEN q.lon ELSE 10.35 + 0.013 * k END AS lon
  FROM (SELECT *, CAST(split_part(stopPlaceRef, ':', 3) AS DOUBLE)::INT AS k FROM quays) AS q
)"""

CLEAN = """
marked AS (
  SELECT a.*, s.quay_id, s.name AS stop, s.lat, s.lon,
    row_number() OVER (PARTITION BY a.serviceJourneyId, a.operatingDate, s.quay_id
      ORDER BY a.sequenceNr) AS visit,
    min(a.sequenceNr) FILTER (WHERE a.extraCall OR a.estimated OR a.journeyCancellation
      OR a.stopCancellation) OVER (PARTITION BY a.serviceJourneyId, a.operatingDate) AS bad_nr,
    epoch(a.arrivalTime) - lag(epoch(coalesce(a.arrivalTime, a.departureTime))) OVER along AS took,
    epoch(a.aimedArrivalTime)
      - lag(epoch(coalesce(a.aimedArrivalTime, a.aimedDepartureTime))) OVER along AS should_take
  FROM arrivals AS a JOIN stopdata AS s ON a.stopPointRef IN (s.quay_id, s.stop_id)
  WINDOW along AS (PARTITION BY a.serviceJourneyId, a.operatingDate
    ORDER BY a.sequenceNr, s.quay_id)
), clean AS (
  SELECT *, epoch(coalesce(arrivalTime, departureTime))
      - epoch(CASE WHEN arrivalTime IS NULL THEN aimedDepartureTime ELSE aimedArrivalTime END) AS late
  FROM marked
  WHERE visit = 1 AND sequenceNr < coalesce(bad_nr, 1000000)
    AND abs(coalesce(took, 0) - coalesce(should_take, 0)) <= 7200
    AND (late IS NULL OR late BETWEEN -7199.999999 AND 7199.999999)
)"""

ROUTES = """
ends AS (
  SELECT DISTINCT operatingDate, dataSource, lineRef, directionRef, serviceJourneyId,
    last_value(stop) OVER whole AS destination, first_value(stop) OVER whole AS origin
  FROM clean
  WINDOW whole AS (PARTITION BY operatingDate, dataSource, serviceJourneyId, lineRef, directionRef
    ORDER BY sequenceNr, quay_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), tallied AS (
  SELECT operatingDate, dataSource, lineRef, directionRef, destination, origin,
    row_number() OVER (PARTITION BY operatingDate, dataSource, lineRef, directionRef
      ORDER BY count(*) DESC, destination, origin) AS place
  FROM ends GROUP BY operatingDate, dataSource, lineRef, directionRef, destination, origin
), route_name AS (
  SELECT operatingDate, dataSource, lineRef, directionRef, destination, origin
  FROM tallied WHERE place = 1
), canonical AS (
  SELECT *, first_value(directionRef) OVER (PARTITION BY dataSource, lineRef, origin, destination
    ORDER BY operatingDate, directionRef) AS direction
  FROM route_name
)"""


def vincenty(source: str, rounds: int = 5) -> str:
    """CTEs that end in ``metres(from_lat, from_lon, to_lat, to_lon, m)`` for the coordinate
    pairs of ``source``; plain iteration from the longitude difference, more rounds."""
    f, b = WGS84_F, WGS84_A * (1 - WGS84_F)
    parts = [f"""geo0 AS (
  SELECT *, radians(to_lon - from_lon) AS dl, radians(to_lon - from_lon) AS lam,
    atan({1 - f!r} * tan(radians(from_lat))) AS u1, atan({1 - f!r} * tan(radians(to_lat))) AS u2
  FROM (SELECT DISTINCT from_lat, from_lon, to_lat, to_lon FROM {source})
)"""]
    for i in range(1, rounds + 1):
        parts.append(f"""geo{i} AS (
  SELECT from_lat, from_lon, to_lat, to_lon, dl, u1, u2,
    dl + (1 - cc) * {f!r} * sa * (sig + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) AS lam,
    ss, cs, sig, ca, cm
  FROM (SELECT *, {f!r} / 16 * ca * (4 + {f!r} * (4 - 3 * ca)) AS cc,
          coalesce(cs - 2 * sin(u1) * sin(u2) / nullif(ca, 0), 0) AS cm
    FROM (SELECT *, 1 - sa * sa AS ca
      FROM (SELECT *, atan2(ss, cs) AS sig, coalesce(cos(u1) * cos(u2) * sin(lam) / nullif(ss, 0), 0) AS sa
        FROM (SELECT from_lat, from_lon, to_lat, to_lon, dl, u1, u2, lam,
            sqrt((cos(u2) * sin(lam)) ** 2
              + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS ss,
            sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs
          FROM geo{i - 1}))))
)""")
    parts.append(f"""metres AS (
  SELECT from_lat, from_lon, to_lat, to_lon, {b!r} * aa * (sig - bb * ss * (cm + bb / 4 * (
      cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS m
  FROM (SELECT *, 1 + kk / 16384 * (4096 + kk * (-768 + kk * (320 - 175 * kk))) AS aa,
      kk / 1024 * (256 + kk * (-128 + kk * (74 - 47 * kk))) AS bb
    FROM (SELECT *, ca * {(WGS84_A**2 - b**2) / b**2!r} AS kk FROM geo{rounds}))
)""")
    return ",\n".join(parts)


LEGS = """
steps AS (
  SELECT operatingDate, lineRef, dataSource, directionRef, serviceJourneyId,
    lag(sequenceNr) OVER w AS nr, lag(coalesce(arrivalTime, departureTime)) OVER w AS left_at,
    lag(coalesce(aimedArrivalTime, aimedDepartureTime)) OVER w AS due_at,
    arrivalTime AS came, aimedArrivalTime AS due, late, stop AS to_stop, lag(stop) OVER w AS from_stop,
    lat AS to_lat, lon AS to_lon, lag(lat) OVER w AS from_lat, lag(lon) OVER w AS from_lon
  FROM clean
  WINDOW w AS (PARTITION BY serviceJourneyId, operatingDate ORDER BY sequenceNr, quay_id)
), {vincenty},
legs AS (
  SELECT operatingDate, lineRef, dataSource, directionRef, direction, serviceJourneyId,
    nr AS sequenceNr, left_at AS start_time, actual AS actual_duration, planned AS planned_duration,
    CAST(late AS INT) AS delay, actual - planned AS deviation, to_stop, from_stop, to_lat, to_lon,
    from_lat, from_lon, CAST(m AS INT) AS air_distance_meters
  FROM (SELECT *, CAST(epoch(came) - epoch(left_at) AS INT) AS actual,
      CAST(epoch(due) - epoch(due_at) AS INT) AS planned FROM steps)
    JOIN metres USING (from_lat, from_lon, to_lat, to_lon)
    JOIN canonical USING (operatingDate, lineRef, dataSource, directionRef)
  WHERE abs(CAST(late AS INT)) < 7200 AND planned >= 0 AND planned <= 7200
    AND abs(actual - planned) < 7200 AND actual >= 2 AND CAST(m AS INT) >= 1
    AND CAST(m AS INT) * 3.6 < 250.0 * actual
)""".replace("{vincenty}", vincenty("steps"))

LEG_STATS = """
weekday_legs AS (
  SELECT *, CAST(date_trunc('month', operatingDate) AS DATE) AS month, hour(start_time) AS hour
  FROM legs WHERE isodow(start_time) <= 5
), per_month AS (
  SELECT dataSource, from_stop, to_stop, month,
    CAST(median(actual_duration) AS INT) AS monthly_duration,
    quantile_disc(actual_duration, 0.75) AS monthly_quartile,
    CAST(median(delay) AS INT) AS monthly_delay, CAST(median(deviation) AS INT) AS monthly_deviation,
    CAST(avg(actual_duration) AS INT) AS mean_monthly_duration, count(*) AS monthly_count,
    min(air_distance_meters) AS air_distance_meters, min(from_lat) AS from_lat,
    min(from_lon) AS from_lon, min(to_lat) AS to_lat, min(to_lon) AS to_lon
  FROM weekday_legs GROUP BY dataSource, from_stop, to_stop, month
), per_hour AS (
  SELECT dataSource, from_stop, to_stop, month, hour,
    quantile_disc(actual_duration, 0.75) AS hourly_quartile,
    CAST(median(actual_duration) AS INT) AS hourly_duration,
    CAST(median(delay) AS INT) AS hourly_delay, CAST(median(deviation) AS INT) AS hourly_deviation,
    CAST(avg(actual_duration) AS INT) AS mean_hourly_duration, count(*) AS hourly_count
  FROM weekday_legs GROUP BY dataSource, from_stop, to_stop, month, hour
), leg_stats AS (
  SELECT * FROM per_hour NATURAL JOIN per_month
  WHERE hourly_count >= 21 AND air_distance_meters >= 51
), stop_line AS (
  SELECT DISTINCT lineRef, dataSource, from_stop, to_stop FROM legs
)"""

STUDY = """
successive AS (
  SELECT b.lineRef, a.stopPointName AS previous_stop_name, a.stopPointRef AS previous_stop,
    b.stopPointName AS stop_name, b.stopPointRef AS stop, b.datedServiceJourneyId,
    b.arrivalTime AS time, b.aimedArrivalTime AS planned_time,
    epoch(b.aimedArrivalTime) - epoch(a.aimedArrivalTime) AS planned_duration,
    epoch(b.arrivalTime) - epoch(a.arrivalTime) AS actual_duration,
    epoch(b.arrivalTime) - epoch(b.aimedArrivalTime) AS delay,
    NOT (b.journeyCancellation OR b.stopCancellation OR b.extraCall) AS usable
  FROM arrivals AS a JOIN arrivals AS b
    ON b.datedServiceJourneyId = a.datedServiceJourneyId AND b.sequenceNr - a.sequenceNr = 1
), study AS (
  SELECT * EXCLUDE (usable), actual_duration - planned_duration AS deviation FROM successive
  WHERE usable AND abs(actual_duration - planned_duration) < 1800 AND abs(delay) < 3600
), distances AS (
  SELECT previous_stop, x.lon AS prev_lon, x.lat AS prev_lat, stop, y.lon AS now_lon, y.lat AS now_lat,
    12756.0 * asin(sqrt(sin(radians(y.lat - x.lat) / 2) ** 2
      + cos(radians(x.lat)) * cos(radians(y.lat)) * sin(radians(y.lon - x.lon) / 2) ** 2))
      AS air_distance_km
  FROM (SELECT DISTINCT previous_stop, stop FROM study)
    JOIN quays AS x ON x.id = previous_stop JOIN quays AS y ON y.id = stop
), far_study AS (
  SELECT *, air_distance_km * 3600 / nullif(actual_duration, 0) AS speed_kmh_upper_bound
  FROM study NATURAL JOIN distances WHERE previous_stop <> stop
), timed AS (
  SELECT *, year(time) AS year, month(time) AS month, hour(time) AS hour FROM far_study
  WHERE actual_duration > 0 AND speed_kmh_upper_bound < 250
)"""

GOOD = """
good AS (
  SELECT * FROM arrivals WHERE (serviceJourneyId, operatingDate) NOT IN (
    SELECT (serviceJourneyId, operatingDate) FROM arrivals
    WHERE extraCall OR estimated OR journeyCancellation OR stopCancellation)
)"""

NEEDS = {
    "arrivals": [ARRIVALS],
    "quays": [QUAYS],
    "stopdata": [QUAYS, STOPDATA],
    "clean": [ARRIVALS, QUAYS, STOPDATA, CLEAN],
    "routes": [ARRIVALS, QUAYS, STOPDATA, CLEAN, ROUTES],
    "legs": [ARRIVALS, QUAYS, STOPDATA, CLEAN, ROUTES, LEGS],
    "stats": [ARRIVALS, QUAYS, STOPDATA, CLEAN, ROUTES, LEGS, LEG_STATS],
    "study": [ARRIVALS, QUAYS, STUDY],
    "good": [ARRIVALS, GOOD],
}


def with_base(base: str, statement: str) -> str:
    return "WITH " + ",".join(NEEDS[base]).strip() + "\n" + statement
