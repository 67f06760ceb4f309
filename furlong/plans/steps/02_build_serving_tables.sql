-- Each run writes tables of its own; the views move to them once they are complete.
CREATE TABLE IDENTIFIER(:prefix || '_serving.races_' || :run) USING parquet AS
SELECT * FROM plan_serving_races;
CREATE TABLE IDENTIFIER(:prefix || '_serving.entries_' || :run) USING parquet AS
SELECT * FROM plan_serving_entries;
CREATE OR REPLACE VIEW IDENTIFIER(:prefix || '_serving.races') AS
SELECT * FROM IDENTIFIER(:prefix || '_serving.races_' || :run);
CREATE OR REPLACE VIEW IDENTIFIER(:prefix || '_serving.entries') AS
SELECT * FROM IDENTIFIER(:prefix || '_serving.entries_' || :run);
