-- Spread of the horses' shares of races by venue, up to the day :as_of.
CREATE TABLE IDENTIFIER(:prefix || '_ml.venue_baseline_' || :run) USING parquet AS
SELECT r.kaisai_basho AS venue, count(DISTINCT e.ketto_num) AS horses, count(*) AS starts, max(r.kaisai_date) AS last_day
FROM IDENTIFIER(:prefix || '_serving.entries') e
JOIN IDENTIFIER(:prefix || '_serving.races') r ON r.race_id = e.race_id
WHERE r.kaisai_date <= CAST(:as_of AS DATE)
GROUP BY r.kaisai_basho;
CREATE OR REPLACE VIEW IDENTIFIER(:prefix || '_ml.venue_baseline') AS
SELECT * FROM IDENTIFIER(:prefix || '_ml.venue_baseline_' || :run);
