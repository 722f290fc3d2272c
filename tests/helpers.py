"""Fresh policy-like files in the shape of an internal document collection."""

import os

FILES = {
    "hr_leave_policy_internal.md": "# HR\n\n## Leave Policy\nNhân viên chính thức được hưởng 12 ngày nghỉ phép mỗi năm. Đơn xin nghỉ phép gửi trước 3 ngày làm việc.\n\n## Overtime\nLàm thêm giờ phải được quản lý trực tiếp phê duyệt trước.\n",
    "engineering_onboarding_public.md": "# Engineering\n## Onboarding\nKỹ sư mới hoàn thành thiết lập máy trong tuần đầu tiên.\n## Code Review\nMỗi thay đổi cần ít nhất hai người duyệt. SLA duyệt mã là 24 giờ.\n",
    "operations_it_helpdesk_sla_public_2024-09-25.md": "# Operations\n## SLA hỗ trợ IT\nSự cố mức cao phản hồi trong 2 giờ. Sự cố mức thấp phản hồi trong 3 ngày.\n## Kênh hỗ trợ\nGửi phiếu qua cổng hỗ trợ IT.\n",
    "security_access_restricted.md": "# Security\n## Credentials\nThông tin đăng nhập nhạy cảm phải được xoay vòng sau mỗi 90 ngày.\n",
    "legal_document_retention_internal_2024-10-28.txt": "# Legal\n## Thời hạn lưu trữ hồ sơ\nHồ sơ hợp đồng được lưu trữ tối thiểu 10 năm.\n## Lưu trữ và truy xuất\nBản gốc đặt tại kho hồ sơ trung tâm.\n",
    "notes/broken_public.HTML": b"<p>caf\xc3\xa9 \xff bar</p>",
    "empty.md": " \n",
    "ignored.csv": "a,b",
}


def write_files(folder):
    for name, text in FILES.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            out.write(text if isinstance(text, bytes) else text.encode())
