"""Small invented configuration and files for the tests."""

from __future__ import annotations

from pathlib import Path

from marque.operators.makers import Makers

MAKERS = Makers.of({
    "manufacturers": {"Porsche": {"country": "DE"}, "BMW": {"country": "DE"}, "Alfa Romeo": {"country": "IT"}, "Mercedes-AMG": {"country": "DE"}, "Lucid": {"country": "US"}, "Napier": {"country": "GB"}, "Tesla": {"country": "US"}, "Ford": {"country": "US"}, "MG": {"country": "GB"}, "Audi": {"country": "DE"}},
    "aliases": {"Bmw": "BMW", "Lucid Motors": "Lucid", "Alfa": "Alfa Romeo"},
    "multi_word_manufacturers": ["Alfa Romeo", "Mercedes-AMG"],
    "country_names": {"DE": "Germany", "US": "United States"},
})

FILES = {
    "ll.csv": "Year Make Model, Lap Time\n2019 Porsche 911 GT3,2:44.9\nBad row,2:30.0\n",
    "nr.csv": 'Vehicle,Time,Driver,Date\nPorsche 911 GT2 RS,6:40.3,X,2018\nPorsche 918 Spyder,6:57.0,"Marc, L",4 Sep 2013\nFord X,4:59.0,,\nFord Y,5:00.0,,\nFord Z,15:00.0,,\n',
    "tg.csv": "Car,Time,Episode\nPorsche Carrera GT[1],1:19.8,S5\nFord A,0:59.0,S1\nFord B,3:01,S1\n",
    "ac.csv": "Car,Time,Model year,Propulsion\nTesla Model S,2.1,2021,Battery electric\nFord A,0.9,2000,\nFord B,30.1,2000,\n",
    "sp.csv": "Make and model,Top speed,Year,Engine\nPorsche A,320 km/h,2001,flat-6 engine\nFord B,200 mph,2002,V8 engine\nFord C,\"205 mph (330 km/h)\",2003,\nFord D,40 mph,,\n",
    "po.csv": 'Vehicle,Power,Year,Type\nBmw A/Bmw B,"1,020 hp",2020/2021,Battery electric\nPorsche 911 GT3/GT3 RS,500 hp,2019,Internal combustion\nFord Z,3001 hp,2001,ICE\n',
    "epa.csv": "make,model,year,cylinders,displ,drive,VClass,tCharger,sCharger,fuelType1\nBmw,M5,2018,8,4.4,All-Wheel Drive,Midsize Cars,T,,Premium Gasoline\nBmw,X,2018,7,0,,Unknown,,,\n",
    "kg.csv": 'Make,Modle,Year_from,Trim,Body_type,cylinder_layout,number_of_cylinders,boost_type,engine_placement,drive_wheels,capacity_cm3,engine_type,acceleration_0_100_km/h_s,max_speed_km_per_h,engine_hp,max_power_kw,maximum_torque_n_m,curb_weight_kg\nBMW,M5,2018,M5,Sedan,V-type,8,Biturbo,"front, longitudinal",full,4395,Gasoline,3.4,250,600,441,750,1930\nFord,F,2001,Sport,Coupe,Inline,4,none,-,,1999,Gasoline,,,,100,,\n',
    "rs.csv": 'hrst_make,hrst_model,hrst_submodel,hrst_year,hrst_body_style,hrst_fuel_type,make,model,year,engine_type,vehicle_type,displacement,zero_to_60_mph,zero_to_100_mph,quarter_mile_time,quarter_mile_speed,top_speed,braking_70_0,braking_100_0,skidpad_g,power_hp,torque_lb_ft,curb_weight,url\nBMW,M5,BMW M5 Test,2018,sedan,gas,,,,twin-turbocharged V-8,"front-engine, all-wheel-drive",268,2.8,,10.9,129,,150,,0.97,600,553,4180,u\n,,,,,,Alfa Romeo Giulia,Quadrifoglio,2017,turbocharged inline-4,,,5.1,,,,,,,,280,,,\n,,,,,,Ford,X,2017,,,,,,,,,,,,300,,,\n,Romeo 4C,,2015,,,Alfa,,,,,,4.1,,,,,,,,,,,\n',
    "a/engines.csv": 'automobile_id,specs,name\n1,"{""Engine Specs"":{""Cylinders:"":""V8"",""Power:"":""510 hp"",""Fuel:"":""Gasoline""},""Weight Specs"":{""Unladen Weight:"":""3500 lbs""}}",e\n2,not json,e\n9,"{}",e\n',
    "a/automobiles.csv": 'id,image,brand_id,name\n1,"ALFA ROMEO  Giulia 2016-2020 Photos, engines &amp; full specs",1,http://x\n2,T,1,u\n',
    "tables.html": "<h2>Skip</h2><table><tr><td>no</td></tr></table><h2>Petrol <b>cars</b></h2><table class='wikitable sortable'><tr><th>Vehicle</th><th>Power (hp)</th><th>Year</th></tr><tr><td>Ford A&amp;B</td><td>300 hp</td><td>2001</td></tr><tr><td>Tesla S</td><td>400 hp</td></tr></table><h2>Two</h2><table class=wikitable><tr><th>Car</th></tr><tr><td>x</td></tr></table>",
}


def write_files(folder: Path) -> Path:
    for n, t in FILES.items():
        p = folder / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(t, encoding="utf-8")
    return folder
