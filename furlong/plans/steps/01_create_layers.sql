-- One database a layer. :base is the root of the layered tables.
CREATE DATABASE IF NOT EXISTS IDENTIFIER(:prefix || '_raw') LOCATION :raw_dir;
CREATE DATABASE IF NOT EXISTS IDENTIFIER(:prefix || '_core') LOCATION :core_dir;
CREATE DATABASE IF NOT EXISTS IDENTIFIER(:prefix || '_serving') LOCATION :serving_dir;
CREATE DATABASE IF NOT EXISTS IDENTIFIER(:prefix || '_ml') LOCATION :ml_dir;
