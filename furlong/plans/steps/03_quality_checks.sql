-- Figures of the serving tables as of the day :as_of.
CREATE TABLE IDENTIFIER(:prefix || '_serving.day_report_' || :run) USING parquet AS
SELECT CAST(:as_of AS DATE) AS as_of,
       count(*) AS races,
       count_if(kaisai_date <= CAST(:as_of AS DATE)) AS races_held,
       max(kaisai_date) FILTER (WHERE kaisai_date <= CAST(:as_of AS DATE)) AS last_day,
       datediff(CAST(:as_of AS DATE), max(kaisai_date) FILTER (WHERE kaisai_date <= CAST(:as_of AS DATE))) AS days_since,
       (SELECT count(*) FROM IDENTIFIER(:prefix || '_serving.entries')) AS entries
FROM IDENTIFIER(:prefix || '_serving.races');
CREATE OR REPLACE VIEW IDENTIFIER(:prefix || '_serving.day_report') AS
SELECT * FROM IDENTIFIER(:prefix || '_serving.day_report_' || :run);
