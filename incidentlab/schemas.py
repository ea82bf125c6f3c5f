"""Declared schemas of the staged input files.

Column names are those of the agencies' own files. Yearly files may lack columns; those
are read as NULL when the frames are stacked.
"""

DEATHS = """rec_id string, fe_id string, mpv_id string, wapo_id string, wa_id string,
 name string, date date, year int, month string, day int, leg_year string, not_kbp int,
 suicide int, vpursuit string, victim string, injury string, incident_num double, cod string,
 description string, agency string, agency_type string, city string, county string,
 district string, latitude double, longitude double, url_info string, url_click string"""

AGENCIES = "agency string, ORI string, population long, accredited string"

STATE_PERSON = """par string, year int, crash_dt date, accmon double, accday double,
 vnumber int, pnumber int, ptype int, spuse int, numoccs int, regowner int,
 cf1 int, cf2 int, cf3 int, crf1 int, crf2 int, crf3 int,
 drf1 int, drf2 int, drf3 int, drf4 int, city int, county int, co_char string,
 x double, y double, pforms int, vforms int, nmforms int, numfatal int, injury int,
 age int, sex int, race_me string, hispanic string, repjur int, investjur string,
 repag_long string, diedscene int, death_dt date"""

STATE_CRASH = """`Collision Report Number` string, `Unit Number` int,
 `Involved Person Type` string, `Injury Type` string,
 `MV Driver Miscellaneous Action 1` string, `MV Driver Miscellaneous Action 2` string,
 `MV Driver Miscellaneous Action 3` string, `Vehicle Action 1` string, Age int,
 Gender string, Date date, Year int, `Month Number` int, `City Name` string,
 `County Name` string, `State Plane X` double, `State Plane Y` double,
 `Number of Fatalities` int, `Number of Motor Vehicles Involved` int,
 `On Duty Indicator` string, `ORI#` string"""

NATIONAL_PERSON = """ST_CASE long, VEH_NO int, PER_NO int, STATENAME string, MONTH int,
 DAY int, DEATH_MO int, DEATH_DA int, INJ_SEV int, PER_TYP int, STR_VEH int, AGE int,
 SEXNAME string, HISPANIC int, RACE int"""

NATIONAL_VEHICLE = """ST_CASE long, VEH_NO int, STATENAME string, SPEC_USE int,
 DR_SF1 int, DR_SF2 int, DR_SF3 int, DR_SF4 int"""

NATIONAL_CRASH = """ST_CASE long, STATENAME string, VE_TOTAL int, VE_FORMS int, PEDS int,
 PERSONS int, COUNTY int, CITY int, RUR_URBNAME string, LATITUDE double, LONGITUD double,
 CF1 int, CF2 int, CF3 int, FATALS int"""

NATIONAL_RACE = "ST_CASE long, VEH_NO int, PER_NO int, STATENAME string, RACE int, MULTRACE int"
NATIONAL_DRIVER_FACTOR = "ST_CASE long, VEH_NO int, STATENAME string, DRIVERRFNAME string"
NATIONAL_CRASH_FACTOR = "ST_CASE long, STATENAME string, CRASHRFNAME string"

NEWSPAPER = """Seq int, ST string, County string, City string, Year int, Mo int, Date int,
 Deaths int, People int, Vehs int, `Fleeing driver` string, `Pursuing agency` string"""

COUNTY_CODES = "`county_name` string, `county_code` int"
CITY_CODES = "`city_name` string, `city_code` int"
