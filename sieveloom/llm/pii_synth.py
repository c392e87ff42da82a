"""Made-up sentences with labelled personal information, to train the tagger on more than the tables' own wording.

A text is a few clauses drawn from several grammars (chats, forms, letters, logs, notices; Vietnamese and English), each with values of many forms and with values that look alike but are none: service
numbers, orders, accounts, codes, amounts, dates, brands, schools, streets without a house number. Half of the clauses are a value among random words of a vocabulary, so that values are learnt by their own
shape too and not by a few neighbours alone. Values are marked while the text is put together, so labels are exact.
"""

from __future__ import annotations

import random
import re
import string
from collections import Counter

_SUR = "Nguyen Tran Le Pham Hoang Huynh Phan Vu Vo Dang Bui Do Ho Ngo Duong Ly Dinh Doan Trinh Mai Luong Cao Ta To Luu Dao Quach Kieu Thai Chu Lam Ha Tang Vuong Tong La Ton Mac Ninh Phung".split()
_MID = "Van Thi Huu Duc Minh Quoc Thanh Xuan Ngoc Kim Hong Thu Bao Gia Anh Tuan Hoai Cong Dinh Nhat Phuong My Bich Khanh Trong Tien Quang Viet Hai Dieu".split()
_GIVEN = (
    "An Anh Bach Bao Binh Chau Chi Chien Cuong Cuc Dao Dat Diem Dieu Dong Du Dung Duy Duyen Giang Giao Ha Hai Han Hang Hanh Hao Hau Hien Hiep Hieu Hoa Hoan Hong Hue Hung Huong Huy Huyen Khang Khanh Khoa Khoi Kien "
    "Kieu Lan Lam Le Lien Linh Loan Loc Loi Long Luan Ly Mai Man Manh Minh My Nam Nga Ngan Nghia Ngoc Nguyen Nhan Nhi Nhung Ninh Oanh Phat Phong Phu Phuc Phuong Quan Quang Quy Quyen Quynh Sang Son Tam Tan Thach Thai "
    "Thang Thanh Thao Thinh Thoa Thu Thuan Thuy Tien Tin Toan Tram Trang Tri Trinh Trong Truc Trung Truong Tu Tuan Tung Tuyen Tuyet Uyen Van Vinh Vy Xuan Yen"
).split()
_FIRST = (
    "James Mary John Linda Robert Susan Michael Karen David Lisa Daniel Nancy Paul Betty Mark Helen George Sandra Kevin Donna Brian Carol Edward Ruth Jason Sharon Ryan Laura Eric Amy Adam Anna Nathan Emma Peter Olivia Kyle Grace "
    "Ethan Chloe Marta Pedro Lucia Hans Ingrid Pierre Camille Giulia Marco Sofia Ivan Olga Yuki Kenji Priya Arjun Fatima Omar Chen Mei Jin Sun Noah Zoe Victor Tom Ben Kate Sam Julia Felix Nina Diego Elena"
).split()
_LAST = (
    "Smith Johnson Miller Davis Wilson Anderson Taylor Moore Martin Lee Thompson White Harris Clark Lewis Walker Hall Young King Wright Scott Green Baker Adams Nelson Carter Mitchell Turner Parker Evans Collins Murphy Cook Rogers "
    "Morgan Cooper Reed Bailey Bell Kelly Howard Ward Cox Garcia Lopez Perez Silva Costa Rossi Ferrari Schmidt Weber Dubois Laurent Novak Kowalski Ivanov Petrov Tanaka Sato Suzuki Kim Park Wang Zhang Patel Singh Khan Hassan Jensen"
).split()
_TITLE_VI = "anh chi em co chu bac ong ba thay Anh Chi Em Co Chu Bac Ong Ba".split()
_TITLE_EN = "Mr Mrs Ms Dr Prof Mr. Mrs. Ms. Dr. Sir Madam".split()
_DOMAIN = "gmail yahoo outlook hotmail icloud proton mail fpt vnpt company office school news shop my-mail post inbox corp acme lab uni travel hanoi saigon".split()
_TLD = "com com vn net org edu io co info biz me com.vn edu.vn co.uk de fr jp example test dev app gov.vn".split()
_STREET = "Nguyen Trai,Le Loi,Tran Hung Dao,Hai Ba Trung,Ly Thuong Kiet,Cach Mang Thang Tam,Vo Van Tan,Dien Bien Phu,Nguyen Hue,Phan Chu Trinh,Quang Trung,Le Duan,Pasteur,Hoang Dieu,Bach Dang,Hung Vuong,Truong Chinh,Lac Long Quan,Au Co,Kim Ma,Cau Giay,Xa Dan,Thai Ha,To Hien Thanh".split(",")
_STREET_EN = "Baker Street,Main Street,Oak Avenue,Elm Drive,Maple Road,Church Lane,High Street,King's Road,Sunset Boulevard,Park Avenue,Mill Lane,Station Road,Victoria Square,River Walk,Market Street,Cedar Court".split(",")
_CITY = "Ha Noi,TP HCM,TP.HCM,Da Nang,Can Tho,Hai Phong,Hue,Nha Trang,Da Lat,Vung Tau,Bien Hoa,Thu Duc,Vinh,Quy Nhon,Bac Ninh,Nam Dinh".split(",")
_CITY_EN = "London,Boston,Springfield,Dublin,Leeds,Seattle,Sydney,Toronto,Denver,Austin,Bristol,Oakland,Perth,Glasgow".split(",")
_BRAND = "Minh Long,Hoa Sen,An Phat,Sao Mai,Thien Long,Viet Tien,Kim Cuong,Bao Tin,Dai Phat,Phuc Loc,Lotte,Vina Milk,Green Farm,Blue Sky,North Star,Sunrise,Golden Gate,Tan Hiep Phat,Hoang Anh,Phu Quy".split(",")
_ITEM = "may loc nuoc,ao khoac,dien thoai,tai nghe,noi com,bep tu,sach giao khoa,giay the thao,ban phim,tu lanh,the nho,man hinh,laptop,ca phe,sua tuoi,vitamin".split(",")


class Writer:
    """A text in the making: parts and the labelled spans in it."""

    def __init__(self, rng: random.Random, vocabularies: list[list[str]]):
        self.r, self.text, self.spans, self.vocabularies = rng, "", [], vocabularies

    def put(self, s: str, kind: str | None = None) -> None:
        if kind:
            self.spans.append((kind, len(self.text), len(self.text) + len(s)))
        self.text += s

    def fill(self, form: str) -> None:
        """Writes a form whose {slots} are values or look-alikes."""
        for literal, slot, _, _ in string.Formatter().parse(form):
            self.put(literal)
            if slot:
                getattr(self, f"_{slot}")()

    # ---- values ----

    def _digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def vietnamese(self) -> str:
        r = self.r
        mid = [r.choice(_MID) for _ in range(r.choice([0, 1, 1, 1, 2]))]
        given = [r.choice(_GIVEN)] + ([r.choice(_GIVEN)] if r.random() < 0.25 else [])
        return " ".join([r.choice(_SUR), *mid, *given])

    def western(self) -> str:
        r = self.r
        got = f"{r.choice(_FIRST)} {r.choice(_LAST)}"
        if r.random() < 0.2:
            got = f"{r.choice(_FIRST)} {r.choice(string.ascii_uppercase)}. {r.choice(_LAST)}"
        elif r.random() < 0.1:
            got += f"-{r.choice(_LAST)}"
        return got

    def syllables(self) -> str:
        """A name of a known family with given names that no list has."""
        r = self.r
        one = lambda: (r.choice(["b", "c", "ch", "d", "g", "h", "k", "kh", "l", "m", "n", "ng", "nh", "ph", "q", "s", "t", "th", "tr", "v", "x", ""]) + r.choice(["a", "e", "i", "o", "u", "y", "ie", "uo", "oa", "ua", "uy", "ai", "au"]) + r.choice(["", "", "n", "ng", "nh", "m", "c", "t", "p"])).capitalize()
        return " ".join([r.choice(_SUR), *([r.choice(_MID)] if r.random() < 0.6 else []), *(one() for _ in range(r.choice([1, 1, 2])))])

    def made(self) -> str:
        """A name that no list has."""
        r = self.r
        word = lambda: "".join(r.choice("bcdfghjklmnprstvz") + r.choice("aeiou") + r.choice(["", "", "n", "r", "s", "l"]) for _ in range(r.choice([2, 2, 3]))).capitalize()
        x = r.random()
        if x < 0.15:
            return f"{r.choice(_FIRST)} {r.choice(['O', 'D'])}'{word()}"
        if x < 0.3:
            return f"{r.choice(_FIRST)} {r.choice(['Mc', 'Mac', 'De ', 'Van ', 'Al-', 'St. '])}{word()}"
        return f"{r.choice(_FIRST)} {word()}" if x < 0.6 else f"{word()} {r.choice(_LAST)}" if x < 0.8 else f"{word()} {word()}"

    def _name(self) -> None:
        r = self.r
        x = r.random()
        got = self.vietnamese() if x < 0.45 else self.syllables() if x < 0.55 else self.western() if x < 0.8 else self.made()
        y = r.random()
        self.put(got.upper() if y < 0.08 else got.lower() if y < 0.2 else got, "person_name")

    def _vname(self) -> None:
        got = self.vietnamese()
        if self.r.random() < 0.3:
            self.put(self.r.choice(_TITLE_VI) + " ")
        y = self.r.random()
        self.put(got.upper() if y < 0.1 else got.lower() if y < 0.25 else got, "person_name")

    def _ename(self) -> None:
        if self.r.random() < 0.3:
            self.put(self.r.choice(_TITLE_EN) + " ")
        self.put(self.western() if self.r.random() < 0.8 else self.vietnamese(), "person_name")

    def _given(self) -> None:
        """A title and a given name alone."""
        self.put(self.r.choice(_TITLE_VI) + " ")
        self.put(self.r.choice(_GIVEN), "person_name")

    def _phone(self) -> None:
        r = self.r
        x = r.random()
        if x < 0.62:
            d = "0" + r.choice("35789") + self._digits(8)
            sep = r.choice([" ", ".", "-", " "])
            y = r.random()
            if y < 0.45:
                got = d
            elif y < 0.7:
                got = sep.join([d[:4], d[4:7], d[7:]])
            elif y < 0.8:
                got = sep.join([d[:3], d[3:6], d[6:]])
            elif y < 0.9:
                got = sep.join([r.choice(["+84", "84", "(+84)"]), d[1:4], d[4:7], d[7:]])
            else:
                got = r.choice(["+84", "84", "0084"]) + d[1:]
        elif x < 0.74:
            got = r.choice([f"(0{self._digits(2)}) {self._digits(4)} {self._digits(4)}", f"02{self._digits(1)} {self._digits(4)} {self._digits(4)}", f"024.{self._digits(4)}.{self._digits(4)}", f"028-{self._digits(4)}-{self._digits(4)}"])
        elif x < 0.9:
            a, b, c = r.choice("23456789") + self._digits(2), self._digits(3), self._digits(4)
            got = r.choice([f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1 ({a}) {b} {c}"])
        else:
            got = r.choice([f"+44 20 {self._digits(4)} {self._digits(4)}", f"+44 7{self._digits(3)} {self._digits(6)}", f"+65 {self._digits(4)} {self._digits(4)}", f"+33 {self._digits(1)} " + " ".join(self._digits(2) for _ in range(4)), f"+49 {self._digits(3)} {self._digits(7)}", f"07{self._digits(3)} {self._digits(6)}"])
        self.put(got, "phone")

    def _email(self) -> None:
        r = self.r
        a, b = r.choice([r.choice(_FIRST), r.choice(_GIVEN)]).lower(), r.choice([r.choice(_LAST), r.choice(_SUR)]).lower()
        local = r.choice([f"{a}.{b}", f"{a}{b}", f"{a}_{b}", f"{a[0]}{b}", f"{a}-{b}", f"{a}{self._digits(r.choice([1, 2, 4]))}", f"{a}.{b}{self._digits(2)}", f"{a}+{b}", r.choice(["info", "sales", "support", "hr", "contact", "billing", "cskh"]), b + self._digits(3)])
        domain = r.choice(_DOMAIN) + (r.choice(["-", "."]) + r.choice(_DOMAIN) if r.random() < 0.2 else "") + (self._digits(2) if r.random() < 0.1 else "")
        at, dot = r.choice([("@", ".")] * 9 + [(" (at) ", ".")])
        got = f"{local}{at}{domain}{dot}{r.choice(_TLD)}"
        self.put(got.upper() if r.random() < 0.04 else got, "email")

    def _id(self) -> None:
        """An identity or passport number behind its label."""
        r = self.r
        vi = ["CCCD", "CMND", "cccd", "cmnd", "so CCCD", "so CMND", "can cuoc", "can cuoc cong dan", "chung minh nhan dan", "chung minh thu", "so can cuoc", "CCCD cua toi la", "Số CMND của tôi là", "giay to tuy than so", "so dinh danh ca nhan", "the can cuoc so", "CMND/CCCD"]
        form12, form9 = self._digits(12), self._digits(9)
        spaced = r.choice([lambda x: x, lambda x: x, lambda x: x, lambda x: " ".join(x[i : i + 3] for i in range(0, len(x), 3)), lambda x: ".".join(x[i : i + 3] for i in range(0, len(x), 3))])
        if r.random() < 0.62:
            label, got = r.choice(vi), spaced(r.choice([form12, form12, form9]))
        else:
            label = r.choice(["passport", "Passport", "passport number", "Passport No.", "passport no", "ho chieu", "ho chieu so", "so ho chieu", "ID card", "ID number", "national ID", "identity card no.", "ID no", "travel document", "my passport number is", "identity number", "SSN", "citizen ID"])
            got = f"{self._digits(3)}-{self._digits(2)}-{self._digits(4)}" if label == "SSN" else r.choice([r.choice(string.ascii_uppercase) + self._digits(7), r.choice(string.ascii_uppercase) + self._digits(8), r.choice(string.ascii_uppercase) + r.choice(string.ascii_uppercase) + self._digits(7), form9, form12])
        self.put(label + r.choice([" ", ": ", ":", " so ", " la ", " - ", " is ", " = "]))
        self.put(got, "id_number")

    def _address(self) -> None:
        r = self.r
        n = r.choice([str(r.randrange(1, 999)), f"{r.randrange(1, 300)}/{r.randrange(1, 60)}", f"{r.randrange(1, 200)}{r.choice('ABCDbis')}", f"{r.randrange(1, 99)}-{r.randrange(1, 99)}", f"{r.randrange(1, 99)}/{r.randrange(1, 30)}/{r.randrange(1, 20)}"])
        if r.random() < 0.68:
            lead = r.choice(["", "", "", "so ", "so nha ", "Số "])
            tail = [r.choice(["", "duong ", "pho ", "Đường "]) + r.choice(_STREET)]
            if r.random() < 0.2:
                lead, n, tail = r.choice(["can ho ", "phong ", "Căn hộ "]), r.choice([f"{r.randrange(1, 40)}.{r.randrange(1, 20):02}", f"{r.randrange(1, 30)}{r.choice('ABC')}", str(r.randrange(101, 2900))]), [r.choice(["toa ", "chung cu ", "block ", "tang 5 toa "]) + r.choice(_BRAND), *tail]
            if r.random() < 0.25:
                tail.insert(0, r.choice(["ngo ", "hem ", "kiet "]) + str(r.randrange(1, 400)))
            if r.random() < 0.6:
                tail.append(r.choice(["phuong ", "P.", "P ", "Phường ", "xa ", "thi tran "]) + r.choice([str(r.randrange(1, 20)), r.choice(_STREET)]))
            if r.random() < 0.7:
                tail.append(r.choice(["quan ", "Q.", "Q", "Quận ", "huyen ", "TP "]) + r.choice([str(r.randrange(1, 12)), r.choice(["Binh Thanh", "Go Vap", "Thanh Xuan", "Dong Da", "Son Tra", "Ba Dinh", "Hoan Kiem"])]))
            if r.random() < 0.7:
                tail.append(r.choice(_CITY))
            self.put(lead)
            self.put(f"{n} " + r.choice([", ", ", ", " - "]).join(tail) if r.random() < 0.85 else f"{n}, " + ", ".join(tail), "address")
        else:
            got = f"{n} {r.choice(_STREET_EN)}" + (r.choice([", Apt ", ", Flat ", ", Unit ", " #"]) + str(r.randrange(1, 99)) if r.random() < 0.25 else "")
            if r.random() < 0.8:
                got += f", {r.choice(_CITY_EN)}" + (r.choice([f" {self._digits(5)}", f", {r.choice(['MA', 'CA', 'TX', 'WA'])} {self._digits(5)}", f" {r.choice(['SW', 'NW', 'LS', 'D'])}{self._digits(1)} {self._digits(1)}AB", ""]))
            self.put(r.choice(["", "", "Flat ", "Apartment "]) if got[0].isdigit() else "")
            self.put(got, "address")

    # ---- look-alikes ----

    def _hotline(self) -> None:
        r = self.r
        self.put(r.choice([f"1900 {self._digits(4)}", f"1800{self._digits(4)}", f"1900{self._digits(4)}", f"1800 {self._digits(2)} {self._digits(2)}", f"1900.{self._digits(4)}", "113", "115", self._digits(4), f"1800{self._digits(6)}"]))

    def _order(self) -> None:
        r = self.r
        self.put(r.choice([f"#{self._digits(6)}", f"{r.choice(['DH', 'VN', 'MD', 'ORD', 'HD', 'TK'])}{self._digits(8)}", f"{r.choice(['DH', 'ORD', 'INV'])}-{self._digits(5)}", self._digits(12), self._digits(8), f"{r.choice(string.ascii_uppercase)}{self._digits(2)}{r.choice(string.ascii_uppercase)}{self._digits(5)}"]))

    def _account(self) -> None:
        r = self.r
        self.put(r.choice([self._digits(13), self._digits(10).replace("0", "1", 1) if r.random() < 0.5 else "1" + self._digits(9), self._digits(14), f"{self._digits(4)} {self._digits(4)} {self._digits(4)} {self._digits(4)}", f"****{self._digits(4)}"]))

    def _otp(self) -> None:
        self.put(self.r.choice([self._digits(6), self._digits(4), f"{self._digits(3)} {self._digits(3)}"]))

    def _amount(self) -> None:
        r = self.r
        self.put(r.choice([f"{r.randrange(1, 999)}.000d", f"{r.randrange(1, 99)},{self._digits(3)},000 VND", f"{r.randrange(1, 900)}k", f"${r.randrange(1, 900)}.{self._digits(2)}", f"{r.randrange(1, 20)} trieu", f"{r.randrange(100, 999)} GB"]))

    def _date(self) -> None:
        r = self.r
        d, m, y = r.randrange(1, 29), r.randrange(1, 13), r.randrange(1985, 2030)
        self.put(r.choice([f"{d}/{m}/{y}", f"{d:02}-{m:02}-{y}", f"{y}-{m:02}-{d:02}", f"{d}/{m}", f"ngay {d} thang {m}", f"{r.randrange(0, 24)}h{r.randrange(0, 60):02}", f"{r.randrange(0, 24):02}:{r.randrange(0, 60):02}", f"{m:02}/{y}"]))

    def _url(self) -> None:
        self.put(self.r.choice(["https://", "www.", ""]) + self.r.choice(_DOMAIN) + "." + self.r.choice(_TLD) + self.r.choice(["", "/abc", "/t?id=" + self._digits(4)]))

    def _handle(self) -> None:
        self.put("@" + self.r.choice(_FIRST + _GIVEN).lower() + self.r.choice(["", "_shop", ".official", self._digits(2)]))

    def _brand(self) -> None:
        r = self.r
        self.put(r.choice(["cong ty ", "shop ", "cua hang ", "nha hang ", "Công ty TNHH ", "sieu thi ", "khach san ", "quan ", "", "hang ", "the company ", "nha xe ", "tap doan "]) + r.choice([r.choice(_BRAND), f"{r.choice(_GIVEN)} {r.choice(_GIVEN)}"]) + r.choice(["", "", " Group", " JSC", " Store", " Co., Ltd"]))

    def _place(self) -> None:
        r = self.r
        self.put(r.choice(["duong ", "pho ", "cau ", "cho ", "cong vien ", "truong THPT ", "benh vien ", "san bay ", "ga ", "chi nhanh ", "kho ", "phuong ", "quan ", "buu cuc "]) + r.choice([r.choice(_STREET), r.choice(_CITY), r.choice(_STREET_EN)]))

    def _city(self) -> None:
        self.put(self.r.choice(_CITY + _CITY_EN))

    def _item(self) -> None:
        self.put(self.r.choice(_ITEM))


    # ---- values among random words ----

    def noise(self, words: list[str], most: int) -> str:
        r = self.r
        got = [r.choice(words) for _ in range(r.randrange(most + 1))]
        return " ".join(w.capitalize() if r.random() < 0.04 else str(r.randrange(2000)) if r.random() < 0.03 else w for w in got)

    def among(self) -> None:
        """[words] value [words], with marks or without."""
        r = self.r
        words = r.choice(self.vocabularies)
        before, after = self.noise(words, 7), self.noise(words, 7)
        if r.random() < 0.6:
            before = before[:1].upper() + before[1:]
        if before:
            self.put(before + r.choice([" "] * 8 + [", ", ": ", " (", " - ", "; "]))
        x = r.random()
        if x < 0.5:
            y = r.random()
            if y < 0.15:
                self.put(r.choice(_TITLE_VI + _TITLE_EN) + " ")
            self._name()
            while r.random() < 0.15:
                self.put(r.choice([", ", " and ", " va ", "; ", " & "]))
                self._name()
            if y > 0.95:
                self.put("'s")
        elif x < 0.62:
            self._phone()
        elif x < 0.7:
            self._email()
        elif x < 0.78:
            self._address()
        elif x < 0.84:
            self._id()
        elif x < 0.9:
            getattr(self, r.choice(["_order", "_amount", "_date", "_hotline", "_account", "_otp", "_url", "_handle"]))()
        elif x < 0.95:
            getattr(self, r.choice(["_brand", "_place", "_city", "_item"]))()
        else:
            self.put(r.choice([f"{r.randrange(3000)} {r.choice(words)}", f"{r.randrange(1, 99)},{self._digits(3)} {r.choice(words)}", f"{r.choice(words)} {r.randrange(99)}, {r.choice(words)} {r.randrange(99)}", r.choice(words).capitalize(), f"@{r.choice(words)}", self._digits(r.choice([5, 11, 13])), f"{self._digits(3)}-{self._digits(1)}-{self._digits(2)}-{self._digits(6)}"]))
        if after:
            self.put(r.choice([" "] * 8 + [", ", ") ", ": ", " - ", "; "]) + after)


# Clauses by kind of writing. Every one may stand next to any other.
CLAUSES = """
toi la {vname}, muon hoi ve don {order}|em ten {vname} a|minh la {vname} day|Tên em là {vname}|day la {vname} ben {brand}|xin chao {vname}|Chào {vname}!|kinh gui {vname}|Kính gửi ông {name}|than gui {given}
{vname} vua goi lai|hom qua {vname} co den lay {item}|nho {vname} ky nhan giup|{vname} da thanh toan {amount}|{vname} xac nhan lich {date}|khach {vname} phan nan ve {item}|ban {vname} lop 10A|hop dong dung ten {vname}
nguoi dai dien: {vname}|chu tai khoan: {name}|Ho va ten: {vname}|Họ tên: {vname}|ten khach: {name}|nguoi lien he {vname}|nguoi gui: {name}|Người nhận: {name}|KH {vname}|tai xe {vname}|shipper {vname}|bac si {vname}|luat su {vname}
giao cho {vname}|gap {vname} tai {place}|goi cho {vname} nhe|hoi {vname} phong ke toan|{vname} va {vname} cung di|{vname}, {vname} va {vname} da ky|con trai {vname} sinh {date}|me cua {vname}|vo chong {vname}
dien thoai {phone}|sdt {phone}|SĐT: {phone}|so may {phone}|Tel: {phone}|so moi cua em {phone}|alo {phone}|zalo {phone}|goi {phone} truoc khi giao|lh {phone}|lien lac {phone} sau {date}|nhan tin vao {phone}|di dong: {phone}|so {phone} khong nghe may|hai so {phone} va {phone}|{phone} ({vname})|may ban {phone}|fax {phone}
mail {email}|email: {email}|E-mail: {email}|gui vao {email} giup|hoa don gui ve {email}|tra loi qua {email}|dia chi thu {email}|dang nhap bang {email}|cc {email}|{email} la mail cong viec|lien he {email} hoac {phone}|From: {email}|To: {name} <{email}>|<{email}>
{id}|{id}, cap ngay {date}|{id} cap tai {city}|{id} va sdt {phone}|{vname}, {id}|lam lai the, {id}|xac minh {id}|{id}; sinh {date}|anh chup {id}
giao den {address}|dia chi: {address}|Địa chỉ: {address}|nha o {address}|hien o {address}|ship ve {address}|toi song tai {address}|doi dia chi sang {address}|giao hang tai {address}|nha rieng {address}|thuong tru: {address}|tam tru tai {address}|lay hang o {address}|don toi o {address}|van phong o {address}|ghe {address} truoc {date}
ten {vname}, dia chi {address}, sdt {phone}|{vname} - {phone} - {address}|{vname} | {phone} | {email}|{vname};{phone};{address}|nguoi nhan {vname}, {phone}, {address}|{address} ({vname} nhan)
hotline {hotline}|tong dai {hotline}|goi {hotline} de duoc ho tro|don hang {order}|ma don {order}|ma van don {order}|van don {order} dang giao|STK {account}|so tai khoan {account}|chuyen vao {account}|ma OTP la {otp}|ma xac thuc {otp}|OTP: {otp}, khong chia se|het han {date}|gia {amount}|phi ship {amount}|con no {amount}|hen {date}
mua {item} tai {brand}|{brand} xin thong bao|uu dai tai {brand}|{brand} khai truong|{item} het hang|xem {url}|truy cap {url}|theo doi {handle}|ib {handle}|tai {place}|gan {place}|tu {place} den {place}|ket xe o {place}|hop o {city}|di {city} ngay {date}|bao cao thang {date}|ma the {account}|bien so 51F-{otp}|so hop dong {order}|ma khach hang {order}|phong {otp}|tang 3 {place}|san pham {item} cua {brand}
My name is {ename}|I'm {ename}|this is {ename} from {brand}|Hi {ename}|Dear {ename}|Hello {name},|{ename} called about {item}|please ask {ename}|{ename} will meet you on {date}|met {ename} and {ename} yesterday|Regards, {name}|Best, {name}|Thanks, {name}|Signed: {name}|spoke with {ename}|my husband {name}|the driver {name}|Attn: {name}|written by {name}|patient {name}|{ename} said the {item} is broken|Contact {ename} at {phone}|{name}'s account is locked
call me at {phone}|phone: {phone}|my number is {phone}|text {phone}|reach me on {phone} after {date}|mobile {phone}|Tel. {phone}|cell {phone} or {phone}|WhatsApp {phone}|office {phone}|ring {phone} when you arrive|new number {phone}, old one is dead
write to {email}|my email is {email}|reply to {email}|send it to {email}|contact {email} for details|{email} or {phone}|mailto {email}|forward this to {email} and {email}|e-mail {email}|sign in as {email}|copy {email}
my {id}|{id} expires {date}|checked {id}|holder of {id}|{name}, {id}|the {id} was rejected
ship to {address}|I live at {address}|deliver it to {address}|our office is at {address}|address: {address}|Address: {address}|moved from {address} to {address}|pick up at {address}|Home: {address}|billing address {address}|send the box to {address}|visit us at {address}
order {order} was delayed|your code is {otp}|do not share {otp}|call our service line {hotline}|account {account}|invoice {order}|refund of {amount}|see {url}|follow {handle}|meet near {place}|flight to {city} on {date}|{brand} opens on {date}|the {item} costs {amount}|ticket {order} closed|version {date}|card ending {otp}|room {otp}|page {otp}|password reset at {url}|tracking {order}
cam on|vang a|ok nhe|nho ho tro gap|xin loi vi su bat tien|Xin cảm ơn|de minh kiem tra|khong hai long|hang bi loi|giao nham|rat tot|thank you|please help|as soon as possible|it does not work|see attached|no problem|great service|the meeting went well|we will check and reply|tin nhan nay tu dong|vui long khong tra loi|nang suat tang 20%|thoi tiet dep|Hom nay troi mua|tre em di hoc|bao hanh 12 thang|The weather is nice today|Monday and Tuesday are free|Chuc Mung Nam Moi|Black Friday Sale|Giam Gia Soc|New Year Party|Happy Birthday|Viet Nam vo dich|Cong Hoa Xa Hoi|Ngan Hang Nha Nuoc|So Giao Duc
""".strip().replace("\n", "|").split("|")
_JOIN = (". ", ". ", ", ", "; ", "\n", " - ", "! ", " | ", " ", "? ", ".\n", " / ")


def write(rng: random.Random, vocabularies: list[list[str]]) -> tuple[str, list[tuple[str, int, int]]]:
    """One text and its (kind, start, end)."""
    w = Writer(rng, vocabularies)
    for k in range(rng.choice([1, 1, 2, 2, 3, 4, 6])):
        if k:
            w.put(rng.choice(_JOIN))
        if rng.random() < 0.5:
            w.among()
            continue
        form = rng.choice(CLAUSES)
        w.fill(form[:1].upper() + form[1:] if rng.random() < 0.4 and form[0] != "{" else form)
    if rng.random() < 0.5:
        w.put(rng.choice(".!?.."))
    return w.text, w.spans


def vocabularies(texts: list[str]) -> list[list[str]]:
    """Lower-case words that the given texts hold five times or more, and English ones of the help texts that come with Python."""
    from pydoc_data import topics

    def words(ts: list[str], least: int) -> list[str]:
        n = Counter(w for t in ts for w in re.findall(r"[^\W\d_]{2,}", t) if w.islower())
        return sorted(w for w, k in n.items() if k >= least)

    own = [re.sub(r"\{\w+\}", " ", c) for c in CLAUSES]
    return [words([*texts, *own * 5], 5), [w for w in words([*topics.topics.values(), *own], 1) if w.isascii()]]


def texts(n: int, vocabularies: list[list[str]], seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    rng = random.Random(seed)
    return [write(rng, vocabularies) for _ in range(n)]
