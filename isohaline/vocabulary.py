"""Fixed values shared by every job: dimensions, windows, thresholds and word lists.

Everything here is a constant of bounded size (at most a couple of hundred entries), so it may be
inlined into a plan as literals or turned into a small dimension table and broadcast.
"""

from __future__ import annotations


def _lines(text: str) -> list[str]:
    return [line for line in text.strip().splitlines() if line]


def _table(text: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split("|")] for line in _lines(text)]


# ---- Fixed values: dataset window, radius policy, coordinate envelope ------------------------
MIN_YEAR, MAX_YEAR = 2000, 2026
MIN_DATE, MAX_DATE = "2000-01-01", "2026-12-31"
LATEST_OBSERVATION = "2026-08-21"
DEFAULT_RADIUS_KM, MIN_RADIUS_KM, MAX_RADIUS_KM = 300.0, 1.0, 2000.0
EXPANSION_TIERS_KM = (500.0, 750.0)
ENVELOPE_SOUTH, ENVELOPE_NORTH = -50.0, 30.0
ENVELOPE_WEST, ENVELOPE_EAST = 20.0, 120.0
EARTH_RADIUS_KM = 6371.0088
CELL_DEGREES = 2

# ---- Fixed values: question shapes and measured parameters -----------------------------------
VIEWS = ("profile", "time_series", "regional_average")
PARAMETERS = ("temperature", "salinity", "shallow_sst_proxy")

# ---- Fixed values: observation columns --------------------------------------------------------
EXPORT_COLUMNS = (
    "platform_number cycle_number time latitude longitude pres temp temp_qc temp_adjusted "
    "temp_adjusted_qc psal psal_qc psal_adjusted psal_adjusted_qc data_mode position_qc"
).split()
DERIVED_COLUMNS = "profile_id calendar_month year _source_file source_row".split()
TEXT_COLUMNS = (
    "platform_number cycle_number temp_qc temp_adjusted_qc psal_qc psal_adjusted_qc data_mode position_qc"
).split()
MEASURE_COLUMNS = "latitude longitude pres temp temp_adjusted psal psal_adjusted".split()
MANDATORY_COLUMNS = "platform_number cycle_number time latitude longitude pres data_mode position_qc".split()
CONTRACT_COLUMNS = (
    "platform_number cycle_number profile_id time latitude longitude pres data_mode position_qc "
    "temp_adjusted temp_adjusted_qc psal_adjusted psal_adjusted_qc"
).split()
IDENTITY_COLUMNS = (
    "platform_number cycle_number profile_id time latitude longitude pres data_mode position_qc "
    "calendar_month year _source_file source_row"
).split()
CASE_COLUMNS = (
    "case_id label current_value regional_mean regional_std unfiltered_mean unfiltered_std qc_current "
    "production_mean production_std evidence_grade eligible dataset_version label_reference"
).split()

# ---- Fixed values: quality rule ---------------------------------------------------------------
ACCEPTED_MODES = ("A", "D")
REJECT_REASONS = ("position_qc_not_1", "real_time_mode_excluded", "adjusted_qc_not_1", "null_adjusted_value")
LOW_PROFILE_COUNT = 5

# ---- Fixed values: pressure bins (left-closed; the last edge keeps exactly 500 dbar) ----------
# lower | upper edge | reported upper | label
DEPTH_BINS = [
    (float(lo), float(edge), float(hi), label)
    for lo, edge, hi, label in _table("""
0 | 10 | 10 | 0–10
10 | 25 | 25 | 10–25
25 | 50 | 50 | 25–50
50 | 100 | 100 | 50–100
100 | 200 | 200 | 100–200
200 | 300 | 300 | 200–300
300 | 500.000001 | 500 | 300–500
""")
]

# ---- Fixed values: regions: id | south | north | west | east | name | label | has climatology --
REGIONS = [
    (rid, float(s), float(n), float(w), float(e), name, label, flag == "yes")
    for rid, s, n, w, e, name, label, flag in _table("""
bay-of-bengal | 5 | 22 | 80 | 100 | bay of bengal | Bay of Bengal | yes
arabian-sea | 8 | 25 | 55 | 75 | arabian sea | Arabian Sea | yes
lakshadweep-sea | 7 | 15 | 70 | 77 | lakshadweep sea | Lakshadweep Sea | yes
andaman-sea | 6 | 15 | 92 | 100 | andaman sea | Andaman Sea | yes
equatorial-indian | -10 | 10 | 40 | 100 | equatorial indian ocean | Equatorial Indian Ocean | yes
southern-indian | -50 | -10 | 20 | 120 | southern indian ocean | Southern Indian Ocean | no
indian-ocean | -50 | 30 | 20 | 120 | indian ocean | Indian Ocean | no
gulf-of-oman | 22 | 27 | 56 | 61 | gulf of oman | Gulf of Oman | no
gulf-of-aden | 10 | 16 | 43 | 52 | gulf of aden | Gulf of Aden | no
red-sea | 12 | 30 | 32 | 44 | red sea | Red Sea | no
""")
]
# Names in the order in which ties between equally long names are settled.
REGION_NAME_ORDER = _lines(r"""
southern indian ocean
equatorial indian ocean
bay of bengal
lakshadweep sea
andaman sea
arabian sea
gulf of oman
gulf of aden
red sea
indian ocean
""")

# ---- Fixed values: seasons --------------------------------------------------------------------
SEASON_MONTHS = {
    "monsoon": (6, 7, 8, 9),
    "post-monsoon": (10, 11, 12),
    "pre-monsoon": (3, 4, 5),
    "summer": (4, 5, 6),
    "winter": (12, 1, 2),
}
MONTH_NAMES = _lines(r"""
january
february
march
april
may
june
july
august
september
october
november
december
""")
MONTH_LABELS = [name[:3].capitalize() for name in MONTH_NAMES]
MONTH_SPELLINGS = {name: i for i, name in enumerate(MONTH_NAMES, 1)}
MONTH_SPELLINGS.update({name[:3]: i for i, name in enumerate(MONTH_NAMES, 1)})
MONTH_SPELLINGS["sept"] = 9

# ---- Fixed values: climatology jobs -----------------------------------------------------------
CLIMATOLOGY_PERIODS = {"production": (2000, 2026), "validation": (2000, 2009)}
CLIMATOLOGY_POLICY = "scientific-policy-0.2"
PROFILE_SETS = ("full", "shallow", "upper_100")

# ---- Fixed values: evidence thresholds and check texts ------------------------------------------
THRESHOLDS = {
    "min_valid_profiles": 5,
    "min_baseline_n": 10,
    "min_distinct_floats": 2,
    "min_qc_pass_rate": 0.3,
    "reviewed": True,
}
GRADES = ("Insufficient", "Indicative", "Supported")

# ---- Fixed values: seawater density polynomial (t in deg C, s in PSU), heat content -------------
PURE_WATER = (999.842594, 6.793952e-2, -9.095290e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9)
SALT_TERM = (0.824493, -4.0899e-3, 7.6438e-5, -8.2467e-7, 5.3875e-9)
SEAWATER_DENSITY, SPECIFIC_HEAT = 1025.0, 3850.0

# ---- Fixed values: result limits ----------------------------------------------------------------
TRACE_LIMIT, TS_LIMIT, FLOAT_POSITION_LIMIT, DOCUMENT_LIMIT = 25, 500, 50, 200

# ---- Fixed values: labels of evaluation cases ---------------------------------------------------
CASE_POSITIVE = "upper_ocean_anomaly"
CASE_NEGATIVE = "normal_ocean_state"
CASE_MEASUREMENT = "measurement_quality_problem"
CASE_AMBIGUOUS = "ambiguous_excluded"

# ---- Fixed values: places (search anchors): name | latitude | longitude | label -----------------
PLACES = [
    (name, float(lat), float(lon), label)
    for name, lat, lon, label in _table("""
gujarat | 22.0 | 69.0 | Gujarat coast (Arabian Sea)
maharashtra | 17.5 | 73.0 | Maharashtra coast (Arabian Sea)
karnataka | 13.5 | 74.5 | Karnataka coast (Arabian Sea)
kerala | 9.5 | 76.0 | Kerala coast (Arabian Sea)
goa | 15.49 | 73.83 | Goa coast
kandla | 23.03 | 70.22 | Kandla coast
jamnagar | 22.47 | 70.07 | Jamnagar coast
okha | 22.47 | 69.07 | Okha coast
bhavnagar | 21.77 | 72.15 | Bhavnagar coast
mundra | 22.84 | 69.72 | Mundra coast
diu | 20.71 | 70.98 | Diu coast
daman | 20.42 | 72.84 | Daman coast
mandvi | 22.83 | 69.35 | Mandvi coast
valsad | 20.61 | 72.89 | Valsad coast
bharuch | 21.69 | 72.50 | Bharuch coast
ratnagiri | 16.99 | 73.30 | Ratnagiri coast
alibaug | 18.64 | 72.87 | Alibaug coast
sindhudurg | 16.35 | 73.45 | Sindhudurg coast
dahanu | 19.97 | 72.72 | Dahanu coast
vasai | 19.34 | 72.80 | Vasai coast
malvan | 16.06 | 73.46 | Malvan coast
vengurla | 15.86 | 73.63 | Vengurla coast
karwar | 14.81 | 74.13 | Karwar coast
udupi | 13.34 | 74.75 | Udupi coast
kundapura | 13.63 | 74.68 | Kundapura coast
honnavar | 14.28 | 74.43 | Honnavar coast
bhatkal | 13.98 | 74.55 | Bhatkal coast
kannur | 11.87 | 75.37 | Kannur coast
kasaragod | 12.50 | 74.99 | Kasaragod coast
alappuzha | 9.49 | 76.33 | Alappuzha coast
alleppey | 9.49 | 76.33 | Alappuzha coast
kollam | 8.89 | 76.60 | Kollam coast
quilon | 8.89 | 76.60 | Kollam coast
thrissur | 10.53 | 75.98 | Thrissur coast
varkala | 8.73 | 76.71 | Varkala coast
kovalam | 8.40 | 76.98 | Kovalam coast
beypore | 11.17 | 75.80 | Beypore coast
panaji | 15.49 | 73.83 | Goa coast
port blair | 11.62 | 92.73 | Port Blair
sri lanka | 7.87 | 80.77 | Sri Lanka
lakshadweep | 10.57 | 72.64 | Lakshadweep
chittagong | 22.36 | 91.78 | Chittagong
bangladesh | 21.5 | 90.5 | Bangladesh coast
mozambique | -18.0 | 39.0 | Mozambique coast
madagascar | -18.77 | 47.0 | Madagascar
trivandrum | 8.52 | 76.94 | Thiruvananthapuram coast
thiruvananthapuram | 8.52 | 76.94 | Thiruvananthapuram coast
visakhapatnam | 17.69 | 83.22 | Visakhapatnam coast
puducherry | 11.93 | 79.84 | Puducherry coast
pondicherry | 11.93 | 79.84 | Puducherry coast
rameswaram | 9.29 | 79.31 | Rameswaram coast
tuticorin | 8.76 | 78.13 | Tuticorin coast
thoothukudi | 8.76 | 78.13 | Tuticorin coast
nagapattinam | 10.77 | 79.84 | Nagapattinam coast
cuddalore | 11.75 | 79.77 | Cuddalore coast
machilipatnam | 16.17 | 81.14 | Machilipatnam coast
gopalpur | 19.26 | 84.91 | Gopalpur coast
digha | 21.63 | 87.51 | Digha coast
haldia | 22.03 | 88.06 | Haldia coast
porbandar | 21.64 | 69.61 | Porbandar coast
mangalore | 12.91 | 74.85 | Mangalore coast
mauritius | -20.16 | 57.5 | Mauritius
seychelles | -4.62 | 55.45 | Seychelles
maldives | 4.18 | 73.51 | Maldives
calcutta | 21.6 | 88.4 | Kolkata coast
kolkata | 21.6 | 88.4 | Kolkata coast
kakinada | 16.99 | 82.25 | Kakinada coast
paradip | 20.27 | 86.67 | Paradip coast
karachi | 24.86 | 67.01 | Karachi coast
mumbai | 19.0 | 72.8 | Mumbai coast
bombay | 19.0 | 72.8 | Mumbai coast
chennai | 13.08 | 80.27 | Chennai coast
madras | 13.08 | 80.27 | Chennai coast
kochi | 9.97 | 76.24 | Kochi coast
cochin | 9.97 | 76.24 | Kochi coast
veraval | 20.91 | 70.36 | Veraval coast
dwarka | 22.24 | 68.97 | Dwarka coast
surat | 21.17 | 72.83 | Surat coast
calicut | 11.26 | 75.78 | Kozhikode coast
kozhikode | 11.26 | 75.78 | Kozhikode coast
panjim | 15.49 | 73.83 | Goa coast
vizag | 17.69 | 83.22 | Visakhapatnam coast
andaman | 11.7 | 92.7 | Andaman Islands
nicobar | 7.12 | 93.78 | Nicobar Islands
colombo | 6.93 | 79.85 | Colombo coast
male | 4.18 | 73.51 | Maldives
muscat | 23.59 | 58.41 | Muscat coast
oman | 20.5 | 58.5 | Oman coast
salalah | 16.95 | 54.01 | Salalah coast
gwadar | 25.12 | 62.33 | Gwadar coast
chabahar | 25.29 | 60.64 | Chabahar coast
aden | 12.79 | 45.00 | Aden coast
somalia | 5.0 | 48.0 | Somalia coast
kenya | -4.0 | 39.5 | Kenya coast
tanzania | -7.0 | 39.5 | Tanzania coast
reunion | -21.12 | 55.54 | Reunion
myanmar | 16.0 | 94.0 | Myanmar coast
cox's bazar | 21.43 | 91.98 | Cox's Bazar coast
cox bazar | 21.43 | 91.98 | Cox's Bazar coast
yangon | 16.49 | 96.33 | Yangon coast
rangoon | 16.49 | 96.33 | Yangon coast
phuket | 7.88 | 98.39 | Phuket coast
galle | 6.03 | 80.22 | Galle coast
trincomalee | 8.57 | 81.23 | Trincomalee coast
jaffna | 9.67 | 80.01 | Jaffna coast
mombasa | -4.04 | 39.67 | Mombasa coast
zanzibar | -6.16 | 39.20 | Zanzibar coast
dar es salaam | -6.82 | 39.29 | Dar es Salaam coast
maputo | -25.97 | 32.58 | Maputo coast
toamasina | -18.15 | 49.40 | Toamasina coast
durban | -29.88 | 31.05 | Durban coast
banda aceh | 5.56 | 95.32 | Banda Aceh coast
padang | -0.95 | 100.35 | Padang coast
perth | -31.95 | 115.72 | Perth coast
""")
]

# ---- Fixed values: spelling variant | place or region name ---------------------------------------
ALIASES = [
    (alias, name)
    for alias, name in _table("""
gujrat | gujarat
gujerat | gujarat
gujarath | gujarat
maharastra | maharashtra
mahrashtra | maharashtra
maharasthra | maharashtra
maharashtraa | maharashtra
karnatak | karnataka
karnatka | karnataka
karnata | karnataka
keral | kerala
keralam | kerala
kerela | kerala
bambay | mumbai
bambai | mumbai
mumbay | mumbai
mumbbai | mumbai
mumabi | mumbai
bombay | mumbai
calicat | kozhikode
calicut | kozhikode
calicutt | kozhikode
trivandrum | thiruvananthapuram
trivendrum | thiruvananthapuram
thiruvanantapuram | thiruvananthapuram
thiruvananthpuram | thiruvananthapuram
vizag | visakhapatnam
vishakhapatnam | visakhapatnam
visakapatnam | visakhapatnam
visakhaptnam | visakhapatnam
pondi | puducherry
pondicherry | puducherry
laccadive | lakshadweep
lakshadeep | lakshadweep
lakshdweep | lakshadweep
lakshadip | lakshadweep
cochin | kochi
madras | chennai
calcata | kolkata
calcutta | kolkata
kolkatta | kolkata
mangaluru | mangalore
alapuzha | alappuzha
alleppy | alleppey
arbian sea | arabian sea
arabian | arabian sea
bengal bay | bay of bengal
bay bengal | bay of bengal
""")
]

# ---- Fixed values: phrase families (whole-word; the entries are regular expressions) --------------
SALINITY_PHRASES = _lines(r"""
salinity
psal
salt\w*
salty
saltiness
how salty
fresher
freshness
fresh water
dissolved salt
brackish
diluted
""")

SST_PHRASES = _lines(r"""
sst
sea surface temperature
sea-surface temperature
surface temperature
surface temp
""")

TEMPERATURE_PHRASES = _lines(r"""
temperature
temp
thermal
warm
warmer
warming
warmest
cold
colder
cool
cooler
hot
hotter
heat
heated
heating
how warm
how hot
how cold
water temperature
""")

BOTH_PHRASES = _lines(r"""
temperature and salinity
salinity and temperature
temp and salinity
both parameters
both measurements
both variables
water properties
water conditions
how's the water
how is the water
what's the ocean like
what is the ocean like
everything about
all parameters
ocean conditions
both
""")

PROFILE_PHRASES = _lines(r"""
profile
profiles
by depth
with depth
vertical
water column
depth profile
depth profiles
deep water
shallow water
surface to bottom
vertical structure
""")

SERIES_PHRASES = _lines(r"""
time series
trend
over time
over the years
history
historical
historically
changing
changed
change
increasing
decreasing
rising
falling
warming
cooling
compare
comparison
compared with normal
compared
compared to normal
warmer than usual
getting warmer
getting colder
getting saltier
year by year
monthly trend
""")

REGIONAL_PHRASES = _lines(r"""
average across
mean for the region
average
mean
regional
across
throughout
whole
entire
basin-wide
overall
""")

ANOMALY_PHRASES = _lines(r"""
anomaly
anomalous
unusual
weird
strange
odd
warmer than usual
colder than usual
hotter than usual
cooler than usual
warmer than normal
colder than normal
than usual
than normal
compared with normal
compared to normal
baseline
typical
historical average
is it warming
is it cooling
warming
cooling
getting warmer
getting cooler
has it changed
getting saltier
getting fresher
saltier than
fresher than
abnormal
unusually
compare
comparison
anything unusual
is it weird
out of the ordinary
""")

BLOCKED_TOPICS = _lines(r"""
rain
rainfall
weather forecast
forecast
cyclone
storm track
wave height
waves
tide
tides
fishing
chlorophyll
oxygen
pollution
navigation route
shipping route
nitrate
current speed
sea level rise
sea level
shell command
execute command
run a command
run shell
ignore previous instructions
ignore all instructions
reveal the system prompt
system prompt
developer message
jailbreak
""")

OTHER_OCEANS = _lines(r"""
pacific ocean
atlantic ocean
mediterranean sea
arctic ocean
south china sea
gulf of mexico
caribbean sea
""")
