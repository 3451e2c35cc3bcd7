"""The derived fields written out for another engine, one after the other: the queries' SQL twins, apart from functions.fields.

Each line may name columns of the lattice and the lines above it. ``div`` is spelt out.
"""

NAMES = {"mach^2": "mach2", "v_A^2": "v_a2", "mach_A^2": "mach_a2", "v_A": "v_a", "mach_A": "mach_a", "R": "r_cyl", "R_cyl": "r_cyl"}

LINES = """
x = x1min + (x1max - x1min) * (i + 0.5) / nx1
y = x2min + (x2max - x2min) * (j + 0.5) / nx2
z = x3min + (x3max - x3min) * (k + 0.5) / nx3
dx = (x1max - x1min) / nx1
dy = (x2max - x2min) / nx2
dz = (x3max - x3min) / nx3
dx_mb = dx
dy_mb = dy
dz_mb = dz
zeros = 0.0::DOUBLE
ones = 1.0::DOUBLE
vol = dx * dy * dz
vol_mb = dx * dy * dz
neg_vol = -1 * dx * dy * dz
r = sqrt(x ** 2 + y ** 2 + z ** 2)
r_cyl = sqrt(x ** 2 + y ** 2)
theta = acos(z / nullif(r, 0))
phi = atan2(y, x)
b = asin(z / nullif(r, 0)) * 180 / pi()
l = atan2(y, x) * 180 / pi()
x_sol = x - 8 * 3.0856775814913673e21
r_sol = sqrt(x_sol ** 2 + y ** 2 + z ** 2)
b_sol = asin(z / nullif(r_sol, 0)) * 180 / pi()
l_sol = atan2(y, x_sol) * 180 / pi()
mass = dens * vol
neg_mass = -1 * dens * vol
sqrt_rho = sqrt(dens)
pres = 0.4::DOUBLE * eint
temp = 0.4::DOUBLE * eint / nullif(dens, 0)
temp_cgs = temp * (0.618::DOUBLE * 1.66053906660e-24 / 1.380649e-16)
entropy = pres / nullif(dens ** 1.4::DOUBLE, 0)
cs2 = 1.4::DOUBLE * pres / nullif(dens, 0)
cs = sqrt(cs2)
vtot2 = velx ** 2 + vely ** 2 + velz ** 2
vtot = sqrt(vtot2)
mach2 = vtot2 / nullif(cs2, 0)
mach = sqrt(vtot2 / nullif(cs2, 0))
velr = (velx * x + vely * y + velz * z) / nullif(r, 0)
vtheta = (z * velr - r * velz) / nullif(r_cyl, 0)
vphi = (x * vely - y * velx) / nullif(r, 0)
vrot = sqrt(greatest(vtot2 - velr ** 2, 0))
momx = dens * velx
momy = dens * vely
momz = dens * velz
momr = dens * velr
momtot = dens * sqrt(vtot2)
velin = CASE WHEN velr < 0 THEN velr WHEN velr >= 0 THEN 0 END
velout = CASE WHEN velr > 0 THEN velr WHEN velr <= 0 THEN 0 END
velrin = velin
velrout = velout
jx = y * velz - z * vely
jy = z * velx - x * velz
jz = x * vely - y * velx
amx = y * velz - z * vely
amy = z * velx - x * velz
amz = x * vely - y * velx
amtot = r * vrot
ekin = dens * vtot2 / 2
emag = (bcc1 ** 2 + bcc2 ** 2 + bcc3 ** 2) / 2
etot = ekin + eint + emag
mflxr = dens * velr
mflxrin = dens * velin
mflxrout = dens * velout
mdot = dens * velr
mdotin = dens * velin
mdotout = dens * velout
momflxr = dens * velr ** 2
momflxrin = dens * velr * velin
momflxrout = dens * velr * velout
momflx = dens * velr ** 2
momflxin = dens * velr * velin
momflxout = dens * velr * velout
ekflxr = ekin * velr
ekflxrin = ekin * velin
ekflxrout = ekin * velout
ekflx = ekin * velr
ekflxin = ekin * velin
ekflxout = ekin * velout
eflxrtot = (ekin + 1.4::DOUBLE * eint + emag) * velr
eflxrtotin = (ekin + 1.4::DOUBLE * eint + emag) * velin
eflxrtotout = (ekin + 1.4::DOUBLE * eint + emag) * velout
eflxtot = (ekin + 1.4::DOUBLE * eint + emag) * velr
eflxtotin = (ekin + 1.4::DOUBLE * eint + emag) * velin
eflxtotout = (ekin + 1.4::DOUBLE * eint + emag) * velout
velzin = CASE WHEN velz < 0 THEN velz ELSE 0 END
velzout = CASE WHEN velz > 0 THEN velz ELSE 0 END
mflxz = dens * velz
mflxzin = dens * velzin
mflxzout = dens * velzout
momflxz = dens * velz ** 2
momflxzin = dens * velz * velzin
momflxzout = dens * velz * velzout
ekflxz = ekin * velz
ekflxzin = ekin * velzin
ekflxzout = ekin * velzout
eflxztot = (ekin + 1.4::DOUBLE * eint + emag) * velz
eflxztotin = (ekin + 1.4::DOUBLE * eint + emag) * velzin
eflxztotout = (ekin + 1.4::DOUBLE * eint + emag) * velzout
bccx = bcc1
bccy = bcc2
bccz = bcc3
bccr = (bcc1 * x + bcc2 * y + bcc3 * z) / nullif(r, 0)
btot2 = bcc1 ** 2 + bcc2 ** 2 + bcc3 ** 2
btot = sqrt(btot2)
brot = sqrt(greatest(btot2 - bccr ** 2, 0))
v_a2 = btot2 / nullif(dens, 0)
v_a = sqrt(v_a2)
mach_a2 = vtot2 / nullif(v_a2, 0)
mach_a = sqrt(mach_a2)
beta = 2 * pres / nullif(btot2, 0)
pth_plus_mag = pres + btot2 / 2
temp_mw = mass * temp
temp_vw = vol * temp
velx_mw = mass * velx
velx_vw = vol * velx
vely_mw = mass * vely
vely_vw = vol * vely
velz_mw = mass * velz
velz_vw = vol * velz
bccx_mw = mass * bcc1
bccx_vw = vol * bcc1
bccy_mw = mass * bcc2
bccy_vw = vol * bcc2
bccz_mw = mass * bcc3
bccz_vw = vol * bcc3
beta_mw = mass * beta
beta_vw = vol * beta
tcool = CASE WHEN coolr > 0 THEN eint / coolr ELSE 0 END
tcoldbool = (temp_cgs < 3e-9)::INT::DOUBLE
thotbool = (temp_cgs >= 4e-9)::INT::DOUBLE
trangebool = (temp_cgs >= 2e-9 AND temp_cgs <= 5e-9)::INT::DOUBLE
xyzbool = (x >= -0.25 AND x <= 0.25 AND y >= -0.25 AND y <= 0.4 AND z >= -0.1 AND z <= 0.3)::INT::DOUBLE
tcoldbool_vol = tcoldbool * vol
thotbool_vol = thotbool * vol
trangebool_vol = trangebool * vol
xyzbool_vol = xyzbool * vol
tcoldbool_mass = tcoldbool * mass
thotbool_mass = thotbool * mass
trangebool_mass = trangebool * mass
xyzbool_mass = xyzbool * mass
"""
#: column: expression
FORMULAS = {name.strip(): text.strip() for name, text in (line.split(" = ", 1) for line in LINES.strip().splitlines())}


def column(field: str) -> str:
    return NAMES.get(field, field.lower())


def select(source: str) -> str:
    """All of ``source``'s columns and all fields."""

    return f"SELECT *, {', '.join(f'{text} AS {name}' for name, text in FORMULAS.items())} FROM {source}"
