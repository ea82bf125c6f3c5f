"""Fixed vocabularies: category levels, spelling repairs and abbreviations.

These values define the published categories and must not drift.
"""

# --- fixed values -----------------------------------------------------------------

VICTIM_LEVELS = ["Officer", "Bystander", "Passenger", "Subject"]

INCIDENT_TYPE_LEVELS = [
    "After pursuit homicide",
    "Pursuit vehicular fatality",
    "After pursuit suicide",
    "Attempted stop fatality",
    "Vehicle accident fatality",
    "All other fatalities",
]

PURSUIT_TYPE_LEVELS = [
    "After pursuit suicide",
    "After pursuit homicide",
    "Pursuit vehicular fatality",
]

CAUSE_LEVELS = [
    "Gunshot",
    "Pursuit vehicular fatality",
    "Taser",
    "Asphyxiated/Restrained",
    "All other causes",
]

CODING_LEVELS = [
    "Active pursuit",
    "Terminated pursuit",
    "Involved pursuit",
    "Attempted stop",
    "Vehicle accident",
    "Reviewed not related",
]

PERIODS = ["pre", "reform", "rollback"]

# Applied in this order: the longest name first.
AGENCY_ABBREVIATIONS = [
    ("Washington State Patrol", "WSP"),
    ("Washington", "WA"),
    ("County Sheriff's Office", "Co SO"),
    ("Police Department", "PD"),
]

# Plot labels keep "Washington State Patrol" as "WA State Patrol".
AGENCY_ABBREVIATIONS_PLOT = [
    ("Washington", "WA"),
    ("County Sheriff's Office", "Co SO"),
    ("Police Department", "PD"),
]

# The attempted-stop table shortens the patrol's name last.
AGENCY_ABBREVIATIONS_STOPS = [
    ("Washington", "WA"),
    ("County Sheriff's Office", "Co SO"),
    ("Police Department", "PD"),
    ("State Patrol", "SP"),
]

CITY_SPELLINGS = {
    "DuPont": "Dupont",
    "McCleary": "Mc Cleary",
    "Moxee": "Moxee City",
    "SeaTac": "Seatac",
}

NEWSPAPER_CITY_SPELLINGS = {"Lynwood": "Lynnwood"}

NEAREST_CITY = {
    "Cathcart": "Mill Creek",
    "Birchfield": "Moxee City",
    "Salmon Creek": "Vancouver",
    "Martha Lake": "Mill Creek",
    "Sunnydale": "Burien",
}

# City codes absent from the official list, and their replacement.
CITY_CODE_REPAIRS = {111: 2550, 171: 170, 1124: 1122}

# Words that suggest a vehicle or a chase in a free-text description.
VEHICLE_WORDS = "vehicle|car|crash|speed|chase|pursuit|flee|fled"

MONTH_ABBREVIATIONS = [
    "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
]

# Which sources a linked death was found in, and which of them tagged it.
FOUND_BOTH = "FE+W"
FOUND_VIA_A = "FE+untagged-WTSC"
FOUND_VIA_B = "FE+untagged-WSDOT"
AGENCY_ONLY = "WTSC-only"
CROWD_ONLY = "FE-only"
TAGGED_CROWD, TAGGED_AGENCY, TAGGED_BOTH, TAGGED_OTHER = "FE-only", "W-only", "FE+W", "Other"

# Source id columns of the coverage table: shown name -> column.
SOURCE_IDS = {"FE_ID": "fe_id", "MPV_ID": "mpv_id", "WaPo_ID": "wapo_id", "WaLocal_ID": "wa_id"}

# --- end of fixed values ------------------------------------------------------------
