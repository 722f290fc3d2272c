"""Fixed values that results depend on."""

# Characters below U+0100 are spelled out within classes: Java looks such ones up in a bitmap, and tests a range or (?U)\s
# anew for each character.

#: A token: ASCII letters and digits, U+00C0 to U+1EF9, underscore; SPELLED is the same pattern.
TOKEN = "[0-9A-Za-zÀ-ỹ_]+"
SPELLED = "[0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_" + "".join(map(chr, range(0xC0, 0x100))) + "Ā-ỹ]+"
#: Characters that end a line, all of them white space; LINE is a pattern of line ends.
BREAKS = r"\n\r\x0B\x0C\x1C\x1D\x1E\x85\x{2028}\x{2029}"
#: White space but blanks and line ends.
GAPS = r"\t\x1F\xA0\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
#: White space as Unicode has it, and the four separators U+001C to U+001F; the same as a string.
SPACE = rf"[ {GAPS}{BREAKS}]+"
SPACES = " \t\x1f\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LINE = rf"\r\n|[{BREAKS}]"
QUOTED = "'[^']+'|\"[^\"]+\"|“[^”]+”|‘[^’]+’"

ALIASES = {"branch": "nhanh", "team": "nhom", "thuat": "engineering"}

STOP_WORDS = (
    "la va voi cua cho trong theo duoc can mot nhieu bao khi nao nhu gi thong tin dang moi quy dinh chinh sach tai lieu "
    "muc noi dung huong dan quytrinh quatrinh nhan vien khong co cap dua tren bo phai yeu cau su lau "
    "is are the a an and or of to in"
).split()

NOT_FOUND = "NOT_FOUND"
REFUSAL = "I couldn't find this in the current documents."
CLARIFY = "Ban co the lam ro them bo phan, chinh sach, hoac moc thoi gian lien quan cho cau hoi nay khong? (Cau hoi goc: {})"
PROMPT_HEAD = "You are an enterprise-safe Vietnamese QA assistant.\nOnly answer from provided evidence.\nIf unsupported, output NOT_FOUND.\nReturn JSON with keys: answer, citations, confidence.\n\n"

#: Suffixes of files that can be read.
TEXT_SUFFIXES = ("md", "markdown", "txt", "html", "htm")
BINARY_SUFFIXES = ("pdf", "docx")

#: Fixed questions that no document of the sample collection answers.
NEGATIVE_QUESTIONS = """
Công ty có chính sách cấp cổ phiếu ESOP vesting theo tháng không?
Mức phụ cấp gửi xe máy tại văn phòng chính là bao nhiêu?
Quy định sử dụng phòng gym nội bộ sau 22:00 như thế nào?
Nhân viên có được hỗ trợ học phí thạc sĩ toàn phần không?
Quy trình đổi chỗ đậu xe ô tô theo quý được thực hiện ra sao?
Có chính sách hoàn tiền mua ghế công thái học tại nhà không?
Công ty quy định đồng phục bắt buộc vào thứ Hai như thế nào?
Chính sách thưởng Tết theo hệ số thâm niên chi tiết ra sao?
Nhân viên có thể đăng ký làm thêm ngày Chủ nhật với phụ cấp cố định không?
Quy trình mượn studio quay video marketing nội bộ là gì?
Công ty có chính sách nuôi thú cưng tại văn phòng không?
Mức ngân sách team building quốc tế tối đa mỗi người là bao nhiêu USD?
Quy định thưởng nóng cho sáng kiến AI cấp công ty là gì?
Cách đăng ký phòng ngủ trưa cá nhân tại văn phòng như thế nào?
Chính sách cấp xe công cho nhân viên cấp chuyên viên có không?
Quy định đặt suất ăn đêm miễn phí sau 23:00 là gì?
Công ty có chương trình cho vay mua nhà lãi suất ưu đãi không?
Mức hỗ trợ học tiếng Nhật cho toàn bộ nhân viên là bao nhiêu?
Quy trình xin phép livestream tại khu pantry được quy định thế nào?
Có chính sách làm việc 4 ngày mỗi tuần trong mùa thấp điểm không?
Nhân viên có thể đổi ngày nghỉ phép thành tiền mặt theo tháng không?
Quy định sử dụng drone trong khuôn viên công ty là gì?
Công ty có chính sách tài trợ thi marathon quốc tế cho nhân viên không?
Mức thưởng giới thiệu khách hàng doanh nghiệp mới là bao nhiêu phần trăm?
Quy định mở nhạc tại khu làm việc sau 18:00 như thế nào?
Có chính sách miễn phí gửi con tại nhà trẻ liên kết không?
Thời gian mở cửa thư viện nội bộ vào cuối tuần là mấy giờ?
Quy trình xin chữ ký số cá nhân để ký hợp đồng cá nhân là gì?
Công ty có quy định trang phục lễ hội bắt buộc theo tháng không?
Có chính sách đổi laptop cá nhân sang máy công ty theo nhu cầu không?
""".strip().split("\n")
