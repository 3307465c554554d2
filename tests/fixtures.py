"""Small hand-made inputs."""

from __future__ import annotations

import json

from tarmac.fields import WEATHER_FIELDS

FLIGHT_HEADER = (
    "fl_date,year,month,day_of_month,day_of_week,op_carrier_fl_num,origin,origin_city_name,dest,dest_city_name,"
    "crs_dep_time,crs_arr_time,crs_elapsed_time,distance,carrier_delay,weather_delay,nas_delay,security_delay,"
    "late_aircraft_delay"
)
FLIGHT_LINES = (
    '2023-05-02,2023,5,2,2,211.0,BOI,"Boise, ID",OMA,"Omaha, NE",615,1050,155.0,1147,12,0,3,0,16',
    '2023-05-02,2023,5,2,2,318.0,OMA,"Omaha, NE",TUL,"Tulsa, OK",1125,1240,75.0,352,0,4,7,0,0',
    '2023-05-02,2023,5,2,2,427.0,BOI,"Boise, ID",OMA,"Omaha, NE",1830.0,2305,155.0,1147,2,3,0,1,8',
)
AIRPORTS = (
    ("Boise Air Terminal", 43.5644, -116.2228, "BOI"),
    ("Eppley Airfield", 41.3032, -95.8941, "OMA"),
    ("Tulsa International Airport", 36.1984, -95.8881, "TUL"),
)


def flights_csv(folder, lines=FLIGHT_LINES, header=FLIGHT_HEADER, name="flights.csv") -> str:
    path = folder / name
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def airports_csv(folder, rows=AIRPORTS, name="airports.csv") -> str:
    path = folder / name
    lines = ["id,name,latitude_deg,longitude_deg,iata_code"]
    lines += [f"{i},{','.join('' if value is None else str(value) for value in row)}" for i, row in enumerate(rows)]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def weather_document(value=1.0, **changes) -> str:
    daily = {field: [value] for field in WEATHER_FIELDS}
    for field, replaced in changes.items():
        if replaced is None:
            del daily[field]
        else:
            daily[field] = replaced
    return json.dumps({"daily": daily})


def scheduled(dep, dest, dep_clock, arr_clock="12:30") -> dict:
    return {
        "departure": {"iataCode": dep, "scheduledTime": dep_clock},
        "arrival": {"iataCode": dest, "scheduledTime": arr_clock},
    }
